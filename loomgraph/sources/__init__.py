"""Project files, snapshots, manifests and the run log as tables; and their sinks."""

"""Commits under a guard."""

from __future__ import annotations

import pytest

from loomgraph.sources.repository import BranchMoved, NothingToCommit, Repository

CHANGES = "path string, kind string, from_path string, content string"


def changes(spark, *rows):
    return spark.createDataFrame([(p, kind, old, text) for p, kind, old, text in rows], CHANGES)


def test_commits_follow_one_another(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    assert repo.head("main") == (0, None) and repo.files(None).count() == 0
    one = repo.commit("main", changes(spark, ("a.md", "add", None, "A"), ("b/c.md", "add", None, "C"), ("d.md", "add", None, "A")))
    assert one.parent is None and repo.head("main") == (1, one.commit)
    two = repo.commit("main", changes(spark, ("a.md", "modify", None, "A2"), ("d.md", "delete", None, None), ("b/e.md", "rename", "b/c.md", "C")), expected=one.commit, checked=True)
    assert {tuple(r) for r in repo.files(two.commit).collect()} == {("a.md", "A2"), ("b/e.md", "C")}
    assert {tuple(r) for r in repo.files(one.commit).collect()} == {("a.md", "A"), ("b/c.md", "C"), ("d.md", "A")}
    with pytest.raises(NothingToCommit):
        repo.commit("main", changes(spark, ("a.md", "modify", None, "A2")))
    with pytest.raises(ValueError, match="leaves the project"):
        repo.commit("main", changes(spark, ("../x", "add", None, "x")))
    assert repo.head("main") == (2, two.commit) and repo.head("other") == (0, None)


def test_a_branch_that_moved(spark, tmp_path, monkeypatch):
    repo = Repository(spark, f"file://{tmp_path}/repo")
    one = repo.commit("main", changes(spark, ("a.md", "add", None, "A")))
    own = changes(spark, ("mine.md", "add", None, "M"))
    theirs = repo.commit("main", changes(spark, ("theirs.md", "add", None, "T")))
    with pytest.raises(BranchMoved) as caught:
        repo.commit("main", own, expected=one.commit, checked=True, on_moved="refuse")
    assert caught.value.head == theirs.commit
    done = repo.commit("main", own, expected=one.commit, checked=True)
    assert done.reparented_onto == theirs.commit == done.parent
    assert {r.path for r in repo.files(done.commit).collect()} == {"a.md", "mine.md", "theirs.md"}

    # Another writer gets in between the tables and the head file: once, then each time.
    move, rivals = Repository._move, []

    def beaten(self, branch, number, commit):
        if rivals:
            self_rival = rivals.pop()
            assert move(self, branch, number, self_rival)
        return move(self, branch, number, commit)

    monkeypatch.setattr(Repository, "_move", beaten)
    rivals.append(theirs.commit)
    done = repo.commit("main", changes(spark, ("late.md", "add", None, "L")))
    assert done.reparented_onto == theirs.commit and {r.path for r in repo.files(done.commit).collect()} == {"a.md", "theirs.md", "late.md"}
    rivals += [one.commit, theirs.commit]
    with pytest.raises(BranchMoved):
        repo.commit("main", changes(spark, ("last.md", "add", None, "L")))
    assert repo.head("main")[1] == one.commit

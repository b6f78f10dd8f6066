"""Text, path, hash and JSON functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and the four separators that \s also has in Python.
SPACES = r"(?U)[\s\x1C-\x1F]+"
INLINE_CAP = 512 * 1024
#: Languages by file extension.
LANGUAGES = {"py": "python", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "ts": "typescript", "tsx": "typescript"}
ID_PATTERN = r"^[a-z][a-z0-9_-]{0,63}$"


def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def nfkc(text: Column) -> Column:
    """Unicode NFKC; there is no built-in one."""
    return F.pandas_udf(_nfkc, "string")(text)


def collapse(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize(text: Column) -> Column:
    """NFKC, then collapse.  ASCII texts, which NFKC leaves alone, stay on the JVM."""
    return collapse(F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(nfkc(text)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != "")).cast("bigint")


def related_ids(category: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(category == "other", none).otherwise(F.array(F.concat(category, F.lit("-index"))))


def braced(text: Column) -> Column:
    """The outermost braced span; null without one."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & (F.instr(text, "}") > 0) & (start < end), F.substring(text, start, end - start + 1))


def conclude(text: Column) -> Column:
    """A reply's conclusion as JSON text: the whole reply if it parses, else its braced span if that does, else the text as a JSON string."""
    whole, span = F.try_parse_json(text), F.try_parse_json(braced(text))
    return F.coalesce(F.when(whole.isNotNull(), text), F.when(span.isNotNull(), braced(text)), F.to_json(F.struct(text.alias("text"))).substr(F.lit(9), F.length(F.to_json(F.struct(text.alias("text")))) - 9))


def compact(payload: Column, most: int = 160) -> Column:
    return F.when(F.length(payload) > most, F.concat(F.substring(payload, 1, most - 3), F.lit("…"))).otherwise(payload)


def event_detail(payload: Column) -> Column:
    """What an event shows first: error, a tool call or result, output, value, status."""
    tool = F.get_json_object(payload, "$.tool")
    said = F.coalesce(F.get_json_object(payload, "$.input"), F.get_json_object(payload, "$.output"))
    called = F.when(tool.isNotNull(), F.concat(tool, F.lit(" "), F.coalesce(said, F.lit(""))))
    return F.coalesce(F.get_json_object(payload, "$.error"), called, *[F.get_json_object(payload, f"$.{k}") for k in ("output", "value", "status")])


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code units of an ASCII text; masked each step, so ANSI arithmetic never overflows."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def port_base(project: Column) -> Column:
    return 42000 + (fnv1a(project) % 400) * 20


def slug(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.substring(F.when(plain.rlike("^[a-z]"), plain).otherwise(F.concat(F.lit("project-"), plain)), 1, 64)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot is no extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def language(path: Column) -> Column:
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = F.lit("plaintext")
    for name, kind in LANGUAGES.items():
        out = F.when(extension == name, kind).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """`**/` any directories, `**` anything, `*` within a name, `?` one character of a name."""
    out, at = [], 0
    for m in re.finditer(r"\*\*/|\*\*|\*|\?", pattern):
        out += [re.escape(pattern[at : m.start()]), {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}[m[0]]]
        at = m.end()
    return f"^{''.join(out)}{re.escape(pattern[at:])}$"


def glob_regex_of(pattern: Column) -> Column:
    """glob_regex of a column of patterns."""
    marks = {"**/": ("\x01", "(?:.*/)?"), "**": ("\x02", ".*"), "*": ("\x03", "[^/]*"), "?": ("\x04", "[^/]")}
    out = pattern
    for wildcard, (mark, _) in marks.items():
        out = F.replace(out, F.lit(wildcard), F.lit(mark))
    out = F.regexp_replace(out, r"([\\^$.|+()\[\]{}-])", r"\\$1")
    for mark, regex in marks.values():
        out = F.replace(out, F.lit(mark), F.lit(regex))
    return F.concat(F.lit("^"), out, F.lit("$"))


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def glob_prefix(pattern: Column) -> Column:
    """The directory above the first wildcard."""
    return F.regexp_extract(pattern, r"^([^*?\[]*/)", 1)


def pointer_escape(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def is_id(text: Column) -> Column:
    return text.rlike(ID_PATTERN)


def is_relative_path(path: Column) -> Column:
    """Not empty, not absolute, no two dots anywhere."""
    return (path != "") & ~path.startswith("/") & ~path.contains("..")


def fits_inline(content: Column, cap: int = INLINE_CAP) -> Column:
    return F.octet_length(content) <= cap


def is_graph_document(path: Column) -> Column:
    return path.rlike(r"\.ya?ml$") & (path.contains("graphs/") | F.substring_index(path, "/", -1).contains(".graph."))


def declares_api_boundary(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)#.*$", "").rlike(r"""\bboundary:\s*["']?api\b""")


def utf16_order(text: Column) -> Column:
    """What to sort by for the order of UTF-16 code units, in which characters beyond the first plane come before U+E000."""
    return F.encode(text, "UTF-16BE")


def search(haystack: Column, needle: str) -> Column:
    return F.lower(haystack).contains(needle.lower())

"""Parameter documents: nested sections of keys and typed values as a table, one row for each key.

    [Section]
      key = 1, 'text', |file|   // comment
      [Sub]
      EndSect  // Sub
    EndSect  // Section

Columns: doc, path (array of section names), nth (which of the repeated sections, one number for each name of the path), line,
key, values (array of struct<kind, text>). Sections without keys have a row with a null key. The kinds are int, float, bool,
string and file. Searching, replacing and pivoting are plans over that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc string, path array<string>, nth array<int>, line int, key string, values array<struct<kind: string, text: string>>"
_COMMENT = re.compile(r"""("[^"]*"|'[^']*')|//.*""")
_PART = re.compile(r"""\s*((?:"[^"]*"|'[^']*'|\|[^|]*\||[^,"'|])*)\s*(?:,|$)""")


class DocumentError(ValueError):
    """A document whose sections don't match."""


def typed(token: str) -> tuple[str, str]:
    """Kind and text of one value."""
    token = token.strip()
    if len(token) > 1 and token[0] == token[-1] == "|":
        return "file", token[1:-1]
    if len(token) > 1 and token[0] == token[-1] and token[0] in "'\"":
        return "string", token[1:-1]
    if re.fullmatch(r"[+-]?\d+", token):
        return "int", str(int(token))
    try:
        return "float", repr(float(token))
    except ValueError:
        return ("bool", token.lower()) if token.lower() in ("true", "false") else ("string", token)


def split_values(text: str) -> list[tuple[str, str]]:
    """The values of a line; commas in quotes don't count, and a list of areas is one text."""
    text = text.strip()
    if not text:
        return []
    if "MULTIPOLYGON" in text:
        return [("string", text.strip("'\""))]
    parts, at = [], 0
    while at < len(text):
        found = _PART.match(text, at)
        if not found or found.end() == at:
            return [("string", text)]
        parts.append(found[1])
        at = found.end()
    return [typed(p) for p in parts]


def parse(text: str) -> Iterator[tuple[list[str], list[int], int, str | None, list[tuple[str, str]]]]:
    """path, nth, line, key and values of each key of a document."""
    stack: list[tuple[str, int, dict[str, int], list[int]]] = []
    roots: dict[str, int] = {}
    for number, raw in enumerate(text.splitlines(), 1):
        line = _COMMENT.sub(lambda m: m[1] or "", raw).strip()
        if not line:
            continue
        if line.startswith("[") and line.endswith("]"):
            name = line[1:-1].strip()
            seen = stack[-1][2] if stack else roots
            seen[name] = seen.get(name, 0) + 1
            stack.append((name, seen[name], {}, [0]))
        elif line.lower().startswith("endsect"):
            if not stack:
                raise DocumentError(f"line {number} ends a section that isn't open")
            name, nth, inner, keys = stack[-1]
            if not keys[0] and not inner:
                yield [s[0] for s in stack], [s[1] for s in stack], number, None, []
            stack.pop()
        elif "=" in line and stack:
            key, _, value = line.partition("=")
            stack[-1][3][0] += 1
            yield [s[0] for s in stack], [s[1] for s in stack], number, key.strip(), split_values(value)
        elif stack:
            raise DocumentError(f"line {number} is neither a section nor a key")
    if stack:
        raise DocumentError(f"section {stack[-1][0]!r} isn't ended")


def parse_documents(docs: DataFrame, *, doc: str = "doc", text: str = "text") -> DataFrame:
    """The table of all keys of a column of documents, which are dealt to all tasks: parsing costs far more than moving a text, and a small file may hold many."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, p, n, at, k, [{"kind": a, "text": b} for a, b in v]) for d, t in zip(pdf["doc"], pdf["text"], strict=True) for p, n, at, k, v in parse(t or "")]
            yield pd.DataFrame(out, columns=["doc", "path", "nth", "line", "key", "values"])

    return docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text")).repartition("doc").mapInPandas(rows, SCHEMA)


def read(spark: SparkSession, path: str, *, encoding: str = "cp1252") -> DataFrame:
    """Documents of a path or pattern."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), F.decode("content", encoding).alias("text"))
    return parse_documents(files)


def value(kind: str = "string", at: int = 0) -> Column:
    """The value number ``at`` as a column: int, float, bool or string."""
    text = F.get("values", F.lit(at))["text"]
    return text.try_cast({"int": "long", "float": "double", "bool": "boolean"}.get(kind, "string"))


def at_path(table: DataFrame, path: str) -> DataFrame:
    """Keys below a path such as "a/b"; a last name that is a key gives that key."""
    names = path.split("/")
    inside = F.slice("path", 1, len(names)) == F.array(*map(F.lit, names))
    as_key = (F.col("path") == F.array(*map(F.lit, names[:-1])) if len(names) > 1 else F.lit(False)) & (F.col("key") == names[-1])
    return table.where(inside | as_key)


def without(table: DataFrame, path: str) -> DataFrame:
    """The table after a section or key at a path such as "a/b" has been deleted; :func:`at_path` has what went."""
    return table.join(at_path(table, path).select("doc", "line"), ["doc", "line"], "left_anti")


def holds(table: DataFrame, path: str) -> DataFrame:
    """doc and whether the document has a section or key at a path."""
    found = at_path(table, path).select("doc", F.lit(True).alias("_found")).distinct()
    return table.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("_found", F.lit(False)).alias("holds"))


def search(table: DataFrame, text: str | None = None, *, key: str | None = None, section: str | None = None, param: str | float | bool | None = None, case: bool = False) -> DataFrame:
    """Keys of which the name, a section, or a text value holds the pattern; numbers and booleans have to be equal. Any match counts."""
    fold = (lambda c: c) if case else F.lower
    want = lambda s: F.lit(s if case else s.lower())
    tests = []
    if text is not None:
        key = section = text
        param = text if param is None else param
    if key is not None:
        tests.append(F.contains(fold(F.col("key")), want(key)))
    if section is not None:
        tests.append(F.exists("path", lambda p: F.contains(fold(p), want(section))))
    if isinstance(param, str):
        tests.append(F.exists("values", lambda v: v["kind"].isin("string", "file") & F.contains(fold(v["text"]), want(param))))
    elif isinstance(param, bool):
        tests.append(F.exists("values", lambda v: (v["kind"] == "bool") & (v["text"] == str(param).lower())))
    elif param is not None:
        tests.append(F.exists("values", lambda v: v["kind"].isin("int", "float") & (v["text"].try_cast("double") == float(param))))
    if not tests:
        raise ValueError("nothing to search for")
    found = F.lit(False)
    for t in tests:
        found = found | F.coalesce(t, F.lit(False))
    return table.where(found)


def find_replace(table: DataFrame, old: str | float | bool, new: str | float | bool) -> DataFrame:
    """Values equal to ``old`` become ``new``."""
    def pair(v: object) -> tuple[str, str]:
        if isinstance(v, bool):
            return "bool", str(v).lower()
        return ("int", str(v)) if isinstance(v, int) else ("float", repr(v)) if isinstance(v, float) else ("string", v)

    (old_kind, old_text), (new_kind, new_text) = pair(old), pair(new)
    kinds = ["string", "file"] if old_kind == "string" else ["int", "float"] if old_kind in ("int", "float") else [old_kind]
    same = lambda v: v["kind"].isin(kinds) & ((v["text"].try_cast("double") == float(old)) if old_kind in ("int", "float") else (v["text"] == old_text))
    put = lambda v: F.struct(F.when(v["kind"] == "file", "file").otherwise(F.lit(new_kind)).alias("kind"), F.lit(new_text).alias("text"))
    return table.withColumn("values", F.transform("values", lambda v: F.when(same(v), put(v)).otherwise(v)))


def numbered_sections(table: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """Sections PREFIX1, PREFIX2, ... (or PREFIX_1, ...) as rows: doc, parent, number and the first value of each key as text."""
    name = F.element_at("path", -1)
    number = F.regexp_extract(name, f"^{re.escape(prefix)}_?([0-9]+)$", 1).try_cast("int")
    rows = table.withColumn("number", number).where("number is not null")
    parent = F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), "/")
    first = lambda k: F.min(F.when(F.col("key") == k, F.struct("line", F.get("values", F.lit(0))["text"].alias("v"))))["v"].alias(k)
    return rows.groupBy("doc", parent.alias("parent"), "number").agg(*map(first, keys))


_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "bool"}


def _typed_value(df: DataFrame, column: str) -> Column:
    """array<struct<kind, text>> of a column's value, or of all values of an array column."""
    kind = dict(df.dtypes)[column]
    of = lambda k: _KINDS.get(k, "string")
    one = lambda v, k: F.struct(F.lit(of(k)).alias("kind"), v.cast("string").alias("text"))
    if kind.startswith("array<"):
        return F.transform(column, lambda v: one(v, kind[6:-1]))
    return F.array(one(F.col(column), kind))


def from_rows(rows: DataFrame, prefix: str, keys: list[str], *, doc: str = "doc", parent: str = "parent", number: str = "number", separator: str = "_") -> DataFrame:
    """The inverse of :func:`numbered_sections`: each row becomes a section PREFIX_number below ``parent`` ("a/b"), each of ``keys`` a key with its typed value.

    A null value leaves its key out; arrays become lists of values. Lines are counted from 1 within a document, by parent and number.
    """
    from pyspark.sql import Window as W

    path = F.concat(F.split(parent, "/"), F.array(F.concat(F.lit(f"{prefix}{separator}"), F.col(number).cast("string"))))
    entries = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(k).alias("key"), F.when(F.col(k).isNotNull(), _typed_value(rows, k)).alias("values")) for i, k in enumerate(keys)))
    kept = F.filter(entries, lambda e: e["values"].isNotNull())
    nothing = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("key"), F.array().cast("array<struct<kind: string, text: string>>").alias("values")))
    each = rows.select(F.col(doc).cast("string").alias("doc"), F.col(parent).alias("_p"), F.col(number).alias("_n"), path.alias("path"), F.explode(F.when(F.size(kept) > 0, kept).otherwise(nothing)).alias("e"))
    line = F.row_number().over(W.partitionBy("doc").orderBy("_p", "_n", "e.at"))  # within one document
    return each.select("doc", "path", F.transform("path", lambda _: F.lit(1)).alias("nth"), line.alias("line"), "e.key", "e.values")


def joined(base: DataFrame, other: DataFrame) -> DataFrame:
    """Both tables as one: new keys and sections follow at the end of the section that they belong to, and lines are counted anew.

    A row of ``other`` takes the place behind the last line of the longest part of its path that ``base`` has.
    """
    from pyspark.sql import Window as W

    own = F.struct("path", "nth")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(F.slice("path", F.lit(1), n).alias("path"), F.slice("nth", F.lit(1), n).alias("nth")))
    ends = base.select("doc", "line", F.explode(prefixes).alias("of")).groupBy("doc", "of").agg(F.max("line").alias("end"))
    found = other.select("doc", own.alias("own"), "path", "nth").distinct().select("doc", "own", F.explode(prefixes).alias("of")).join(ends, ["doc", "of"])
    after = found.groupBy("doc", "own").agg(F.max_by("end", F.size("of.path")).alias("_after"))
    placed = other.withColumn("own", own).join(after, ["doc", "own"], "left").select(*base.columns, F.coalesce("_after", F.lit(2_147_483_647)).alias("_a"), F.col("line").alias("_b"))
    both = base.select(*base.columns, F.col("line").alias("_a"), F.lit(0).alias("_b")).unionByName(placed)
    return both.withColumn("line", F.row_number().over(W.partitionBy("doc").orderBy("_a", "_b"))).select(*base.columns)


def cleared(table: DataFrame, path: str) -> DataFrame:
    """The table with the section at a path left empty."""
    names = path.split("/")
    inside = F.slice("path", 1, len(names)) == F.array(*map(F.lit, names))
    first = table.where(inside).groupBy("doc").agg(F.min_by(F.struct(F.slice("nth", 1, len(names)).alias("nth"), "line"), "line").alias("f"))
    none = F.array().cast("array<struct<kind: string, text: string>>")
    empty = first.select("doc", F.array(*map(F.lit, names)).alias("path"), F.col("f.nth").alias("nth"), F.col("f.line").alias("line"), F.lit(None).cast("string").alias("key"), none.alias("values"))
    return table.where(~inside).unionByName(empty)


def get(table: DataFrame, path: str, default: str | None = None) -> DataFrame:
    """doc and the first value at the path of a key, as text; ``default`` where a document has none."""
    first = at_path(table, path).groupBy("doc").agg(F.min_by(value(), "line").alias("_found"), F.count("*").alias("_n"))
    return table.select("doc").distinct().join(first, "doc", "left").select("doc", F.when(F.col("_n") > 0, F.col("_found")).otherwise(F.lit(default)).alias("value"))


def children(table: DataFrame, path: str = "") -> DataFrame:
    """doc, name, is_section, n (how often) and line (of the first) of all keys and sections directly below a path, or of all roots."""
    names = path.split("/") if path else []
    below = table.where(F.slice("path", 1, len(names)) == F.array(*map(F.lit, names))) if names else table
    deep = F.size("path") > len(names)
    entry = F.when(deep, F.struct(F.get("path", F.lit(len(names))).alias("name"), F.lit(True).alias("is_section"))).otherwise(F.struct(F.col("key").alias("name"), F.lit(False).alias("is_section")))
    which = F.when(deep, F.slice("nth", 1, len(names) + 1).cast("string")).otherwise(F.col("line").cast("string"))
    rows = below.select("doc", entry.alias("e"), which.alias("which"), "line").where("e.name is not null")
    return rows.groupBy("doc", "e.name", "e.is_section").agg(F.count_distinct("which").alias("n"), F.min("line").alias("line"))


#: Short names of modules and the sections that they stand for.
ALIASES = {
    "HD": "HYDRODYNAMIC_MODULE",
    "SW": "SPECTRAL_WAVE_MODULE",
    "TR": "TRANSPORT_MODULE",
    "MT": "MUD_TRANSPORT_MODULE",
    "EL": "ECOLAB_MODULE",
    "ST": "SAND_TRANSPORT_MODULE",
    "PT": "PARTICLE_TRACKING_MODULE",
    "DA": "DATA_ASSIMILATION_MODULE",
}


def aliased(table: DataFrame) -> DataFrame:
    """The keys of the modules that are switched on, at paths that begin with the module's short name instead of the document's first section and the module.

    A module is on where MODULE_SELECTION of the same root has mode_of_<module> above 0.
    """
    from pyspark.sql import Window as W

    short = F.create_map(*(F.lit(x) for alias, module in ALIASES.items() for x in (module, alias)))
    root, at = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    document = W.partitionBy("doc")  # one document's lines, so that all lines are read and parsed once
    rooted = table.where("doc is not null").withColumn("_root", F.min_by(root, "line").over(document))
    mode = (F.col("path") == F.array("_root", F.lit("MODULE_SELECTION"))) & F.startswith("key", F.lit("mode_of_")) & (value("int") > 0)
    on = F.collect_set(F.when(mode, F.upper(F.substring("key", 9, 1000)))).over(document)
    rest = lambda c, head: F.concat(F.array(head), F.slice(c, F.lit(3), F.size(c)))
    rows = rooted.withColumn("_on", on).where((root == F.col("_root")) & F.array_contains("_on", at) & short[at].isNotNull())
    return rows.select("doc", rest("path", short[at]).alias("path"), rest("nth", F.get("nth", F.lit(1))).alias("nth"), "line", "key", "values")


def first_of_repeated(table: DataFrame) -> DataFrame:
    """Each key of a section once: the first one."""
    row = table.groupBy("doc", "path", "nth", "key").agg(F.min(F.struct("line", "values")).alias("_row"))
    return row.select("doc", "path", "nth", F.col("_row.line").alias("line"), "key", F.col("_row.values").alias("values"))


def merge(base: DataFrame, other: DataFrame) -> DataFrame:
    """Keys of both tables; where both have a key the other one's values count."""
    on = ["doc", "path", "nth", "key"]
    return other.unionByName(base.join(other.select(*on).distinct(), on, "left_anti"))


def is_unique(table: DataFrame) -> DataFrame:
    """doc and whether no root section is repeated."""
    return table.groupBy("doc").agg((F.max(F.get("nth", F.lit(0))) == 1).alias("is_unique"))


def format_document(rows: list[tuple[list[str], list[int], str | None, list[tuple[str, str]]]]) -> str:
    """The text of a document's rows in line order."""
    out, open_ = [], []
    shown = {"file": "|{}|", "string": "'{}'"}
    for path, nth, key, values in rows:
        want = list(zip(path, nth, strict=True))
        same = 0
        while same < min(len(open_), len(want)) and open_[same] == want[same]:
            same += 1
        while len(open_) > same:
            name = open_.pop()[0]
            out.append("   " * len(open_) + f"EndSect  // {name}")
        while len(open_) < len(want):
            out.append("   " * len(open_) + f"[{want[len(open_)][0]}]")
            open_.append(want[len(open_)])
        if key is not None:
            out.append("   " * len(open_) + f"{key} = " + ", ".join(shown.get(k, "{}").format(t) for k, t in values))
    while open_:
        name = open_.pop()[0]
        out.append("   " * len(open_) + f"EndSect  // {name}")
    return "\n".join(out) + "\n"


def to_text(table: DataFrame) -> DataFrame:
    """doc and text: documents written out again, each by the task that has its rows."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        rows = [(list(p), list(n), k, [(v["kind"], v["text"]) for v in vs]) for p, n, k, vs in zip(pdf["path"], pdf["nth"], pdf["key"], pdf["values"], strict=True)]
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "text": [format_document(rows)]})

    return table.groupBy("doc").applyInPandas(write, "doc string, text string")


def to_dict(text: str) -> dict:
    """A document as nested dictionaries; repeated sections and keys become lists."""
    convert = {"int": int, "float": float, "bool": lambda t: t == "true"}
    out: dict = {}
    made: dict[tuple, dict] = {(): out}

    def put(target: dict, key: str, v: object) -> None:
        if key in target:
            old = target[key]
            target[key] = [*old, v] if isinstance(old, _Repeated) else _Repeated([old, v])
            target[key] = _Repeated(target[key])
        else:
            target[key] = v

    for path, nth, _, key, values in parse(text):
        at: tuple = ()
        for step in zip(path, nth, strict=True):
            if (*at, step) not in made:
                made[(*at, step)] = {}
                put(made[at], step[0], made[(*at, step)])
            at = (*at, step)
        if key is not None:
            plain = [convert.get(k, str)(t) for k, t in values]
            put(made[at], key, plain[0] if len(plain) == 1 else plain)
    return out


class _Repeated(list):
    """Values of a key that occurs several times."""

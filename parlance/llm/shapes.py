"""Nested schema inference: rows become structural fingerprints, equal ones are counted, and only these weighted shapes are looked at.

A fingerprint is a canonical text: an object's members by name, an array's
length as counts of its elements' shapes, and a letter for a plain value. What
the schema says follows from the distinct fingerprints and their counts. All
of it stays in Spark tables: the paths of the shapes are summed up by shuffles,
and objects with many names become maps from the root downwards, a level at a
time, with as many levels as the deepest path has.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: The letters of plain values.
KINDS = {"n": "null", "b": "boolean", "i": "integer", "d": "double", "s": "string"}


@dataclass(frozen=True)
class Limits:
    """Names of one path's objects beyond which they are a map's keys; levels beyond which a text counts as bad; entries and characters that a task holds."""

    max_names: int = 5
    max_depth: int = 200
    held: int = 50_000
    held_chars: int = 1 << 25


LIMITS = Limits()


def _constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=lambda _: 0, parse_float=lambda _: 0.5, parse_constant=_constant)
_LETTER = {type(None): '"n"', bool: '"b"', int: '"i"', float: '"d"', str: '"s"'}


def fingerprint(value: object, levels: int) -> str:
    """The canonical text of a decoded value's shape."""
    plain = _LETTER.get(type(value))
    if plain:
        return plain
    if not levels:
        raise ValueError("too deep")
    if isinstance(value, dict):
        return "{" + ",".join([f"{json.dumps(k)}:{fingerprint(value[k], levels - 1)}" for k in sorted(value)]) + "}"
    return "[" + ",".join(f"[{n},{s}]" for s, n in sorted(Counter(fingerprint(x, levels - 1) for x in value).items())) + "]"


def object_fingerprint(text: str | None, levels: int) -> str | None:
    """The fingerprint of a text that is one whole JSON object, else None."""
    if not text or "{" not in text:
        return None
    try:
        value = _DECODER.decode(text)
        return fingerprint(value, levels) if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


def fingerprints(rows: DataFrame, text: Column, below: Column, wrapped: Column, bad: Column, limits: Limits = LIMITS) -> DataFrame:
    """The distinct shapes of all rows, as (shape, n).

    A row's object stands ``below`` the names of an array column, in an array of
    its own where ``wrapped``. A text that isn't one whole JSON object, or is
    nested deeper than ``limits.max_depth``, has the shape of an exclamation
    mark and ``bad``. Of names that an object repeats the last one counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        known: dict[str | None, str | None] = {}
        chars = 0

        def flush() -> pa.RecordBatch:
            out: Counter = Counter()
            for (shape, names, wrap, name), n in counts.items():
                if shape is None:
                    out[json.dumps(f"!{name}")] += n
                    continue
                shape = f"[[1,{shape}]]" if wrap else shape
                for x in reversed(json.loads(names)):
                    shape = f"{{{json.dumps(x)}:{shape}}}"
                out[shape] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], ["shape", "n"])

        for batch in batches:
            for t, names, wrap, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    shape = known[t]
                except KeyError:
                    if len(known) > limits.held:
                        known.clear()
                    shape = object_fingerprint(t, limits.max_depth)
                    chars += len(shape or "")
                    if t is None or len(t) < 1000:
                        known[t] = shape
                counts[shape, names, wrap, name] += 1
                if len(counts) > limits.held or chars > limits.held_chars:
                    yield flush()
                    chars = 0
        yield flush()

    seen = rows.select(text.alias("t"), F.to_json(below).alias("names"), F.coalesce(wrapped, F.lit(False)).alias("wrapped"), bad.alias("bad"))
    return seen.mapInArrow(run, "shape string, n bigint").groupBy("shape").agg(F.sum("n").alias("n"))


_PATHS = pa.schema([("path", pa.list_(pa.string())), ("kind", pa.string()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _walked(path: tuple, shape: object, n: int, found: dict) -> None:
    """Adds the ``n`` values of a shape, and what they hold, to ``found``: {(path, kind): [n, shortest, longest]}."""
    if isinstance(shape, str):
        kind, length = KINDS[shape], None
    elif isinstance(shape, dict):
        kind, length = "object", None
        for name, x in shape.items():
            _walked((*path, "." + name), x, n, found)
    else:
        kind, length = "array", sum(k for k, _ in shape)
        for k, x in shape:
            _walked((*path, "[]"), x, n * k, found)
    entry = found.setdefault((path, kind), [0, length, length])
    entry[0] += n
    if length is not None:
        entry[1], entry[2] = min(entry[1], length), max(entry[2], length)


def paths(shapes: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(path, kind, n, lo, hi) of weighted shapes: how many values of each kind a path has, and arrays' least and greatest lengths.

    A path is an array of steps: ``$`` first, a dot and a name for members,
    ``[]`` for elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}

        def flush() -> pa.RecordBatch:
            clean = lambda x: x.encode("utf-8", "replace").decode()  # noqa: E731  half a surrogate pair is no text
            rows = [{"path": [clean(s) for s in p], "kind": k, "n": n, "lo": lo, "hi": hi} for (p, k), (n, lo, hi) in found.items()]
            found.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_PATHS)

        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape = json.loads(text)
                if isinstance(shape, str):
                    found.setdefault(((shape,), "bad"), [0, None, None])[0] += n
                else:
                    _walked(("$",), shape, n, found)
                if len(found) > limits.held:
                    yield flush()
        yield flush()

    return _summed(shapes.mapInArrow(run, "path array<string>, kind string, n bigint, lo bigint, hi bigint"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


#: Parts into which the rows below one path fall in a join.
_SALTS = 16


def _spread(rows: DataFrame, has: Column, head: Column, table: DataFrame) -> DataFrame:
    """``rows`` left-joined to ``table`` by ``head``, if they have one; a head that many rows have is looked up by several tasks."""
    salted = rows.where(has).withColumn("head", head).withColumn("salt", F.pmod(F.hash("path", "types" if "types" in rows.columns else "kind"), F.lit(_SALTS)))
    found = salted.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["head", "salt"], "left").drop("head", "salt")
    return found.unionByName(rows.where(~has), allowMissingColumns=True)


def inferred(shapes: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The schema of weighted shapes, a row for each path.

    ``path``; ``types``, the kinds of its values with their counts; ``n_names``,
    how many names its objects show (counted after the replacements above it);
    ``is_map``, whether these all became ``*``, since there were more than
    ``limits.max_names`` (never at the root); ``optional``, whether it is a name
    that some object above it lacks; ``min_len`` and ``max_len`` of its arrays.
    Names with dots in them stay names: paths of different steps are different
    rows. No shapes give no rows.
    """
    table = written(paths(shapes, limits), "paths")
    depth = table.agg(F.max(F.size("path"))).first()[0] or 0
    names: DataFrame | None = None
    for d in range(1, depth):
        member = F.coalesce(F.startswith(F.get("path", F.lit(d)), F.lit(".")), F.lit(False))
        head = F.slice("path", 1, d)
        shown = table.where(member & (F.size("path") == d + 1)).groupBy(head.alias("head")).agg(F.count_distinct(F.get("path", F.lit(d))).alias("n_names"))
        shown = written(shown.withColumn("is_map", (F.col("n_names") > limits.max_names) & (F.lit(d) > 1)), "names")
        names = shown if names is None else names.unionByName(shown)
        if not shown.where("is_map").isEmpty():
            marked = _spread(table, member, head, shown.where("is_map").select("head", "is_map"))
            starred = F.concat(head, F.array(F.lit(".*")), F.slice("path", d + 2, depth))
            before, table = table, written(_summed(marked.withColumn("path", F.when(F.col("is_map"), starred).otherwise(F.col("path")))), "paths")
            removed(before)

    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws(":", x["kind"], x["n"])), "|")
    objects = F.sum(F.when(F.col("kind") == "object", F.col("n")))
    rows = table.groupBy("path").agg(kinds.alias("types"), F.sum("n").alias("n"), F.min("lo").alias("min_len"), F.max("hi").alias("max_len"))
    parents = table.groupBy(F.col("path").alias("head")).agg(objects.alias("objects")).where(F.col("objects").isNotNull())
    last = F.element_at("path", -1)
    named = F.startswith(last, F.lit(".")) & (last != ".*")
    rows = _spread(rows, named, F.slice("path", 1, F.size("path") - 1), parents)
    if names is None:
        names = parents.select("head", F.lit(0).cast("bigint").alias("n_names"), F.lit(False).alias("is_map")).limit(0)
    return rows.join(names, F.col("path") == F.col("head"), "left").select(
        F.array_join("path", "").alias("path"),
        "types",
        F.coalesce("n_names", F.lit(0)).cast("bigint").alias("n_names"),
        F.coalesce("is_map", F.lit(False)).alias("is_map"),
        F.coalesce(F.col("objects") > F.col("n"), F.lit(False)).alias("optional"),
        "min_len",
        "max_len",
    )


def op12_schema_inference(spark, sf_dir: str) -> DataFrame:
    """The schema of all clicks' properties, each below two names that follow from its client and its id."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", "client_id", "props")
    g = F.coalesce(F.pmod("client_id", F.lit(200)), F.lit(0))
    x = F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")), F.lit(0)) % (g % 37 + 1)
    name = F.concat(F.lit("g"), g)
    shapes = fingerprints(clicks, F.col("props"), F.array(name, F.concat(F.lit("x"), x)), F.col("click_id") % 9 == 0, name)
    return inferred(written(shapes, "shapes"))


_NIBBLE = "xor({0} >> 4, crc[({0} & 15) + 1])"
_STEP = _NIBBLE.format("xor(c, b)")
#: The query in SQL: every value of every row, a level at a time. A CRC-32 goes over the digits in half bytes.
OP12_SQL = rf"""
WITH RECURSIVE
t AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce(list_concat([i], range(4)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(16) r(i))),
c AS (
  SELECT click_id, coalesce(client_id % 200, 0) AS g, props, CASE WHEN json_valid(props) THEN json_type(props) = 'OBJECT' ELSE false END AS ok,
    list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(click_id::VARCHAR)), '..'), lambda p: ('0x' || p)::BIGINT)) AS bytes FROM clicks),
r AS (
  SELECT g, ok, props, click_id, coalesce(xor(list_reduce(bytes, lambda c, b: {_NIBBLE.format(f"({_STEP})")}), 4294967295), 0) % (g % 37 + 1) AS x FROM c, t),
w AS (
  SELECT '$' AS path, NULL::VARCHAR AS parent, NULL::VARCHAR AS name,
    ('{{"g' || g || '":{{"x' || x || '":' || CASE WHEN click_id % 9 = 0 THEN '[' || props || ']' ELSE props END || '}}}}')::JSON AS v FROM r WHERE ok
  UNION ALL
  SELECT CASE WHEN name IS NULL THEN path || '[]' WHEN path <> '$' AND count(DISTINCT name) OVER (PARTITION BY path) > 5 THEN path || '.*' ELSE path || '.' || name END, path, name, v
  FROM (
    SELECT path, e.key AS name, e.value AS v FROM (SELECT path, unnest(map_entries(v::MAP(VARCHAR, JSON))) AS e FROM w WHERE json_type(v) = 'OBJECT')
    UNION ALL
    SELECT path, NULL, unnest(v::JSON[]) FROM w WHERE json_type(v) = 'ARRAY')),
k AS (
  SELECT path, CASE coalesce(json_type(v), 'NULL') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
      ELSE CASE WHEN regexp_matches(v::VARCHAR, '[.eE]') THEN 'double' ELSE 'integer' END END AS kind,
    CASE WHEN json_type(v) = 'ARRAY' THEN json_array_length(v)::BIGINT END AS len FROM w
  UNION ALL SELECT '!g' || g, 'bad', NULL FROM r WHERE NOT ok),
s AS (SELECT path, kind, count(*) AS n, min(len) AS lo, max(len) AS hi FROM k GROUP BY ALL),
p AS (SELECT path, string_agg(kind || ':' || n, '|' ORDER BY kind) AS types, sum(n) AS n, coalesce(sum(n) FILTER (WHERE kind = 'object'), 0) AS objects, min(lo) AS min_len, max(hi) AS max_len FROM s GROUP BY 1),
names AS (SELECT parent AS path, count(DISTINCT name) AS n_names FROM w WHERE name IS NOT NULL GROUP BY 1),
up AS (SELECT DISTINCT path, parent FROM w WHERE name IS NOT NULL AND path <> parent || '.*')
SELECT p.path, p.types, coalesce(n_names, 0)::BIGINT AS n_names, coalesce(n_names > 5 AND p.path <> '$', false) AS is_map, coalesce(q.objects > p.n, false) AS optional, p.min_len, p.max_len
FROM p LEFT JOIN names USING (path) LEFT JOIN up ON up.path = p.path LEFT JOIN p q ON q.path = up.parent
"""

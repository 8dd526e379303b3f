"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The ledger
holds (blob, rule, rule_version, spans) for whatever was scanned before, clean blobs
included; a run scans only blob and rule-version pairs that the ledger lacks, appends
them, and joins findings back to all versions and paths with that content.

Spark finds matches but not their places.  ``split`` with the same pattern gives the
text between matches, so the running length of both lists gives each span in code points.

Defined results: a null text is the empty blob and has no findings; repeated rows each
get the findings of their blob; ties in the order of spans go by rule; an empty table
gives no rows; columns other than doc_id and text are not read, and ``drop_leaking``
keeps them all (names that start with __ are an error there).  A text of any length is
scanned whole; its n matches are folded in blocks of sqrt(n), so a log file of many
thousand matches copies n * sqrt(n) spans at the most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, refuse

_LETTERS = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
_NAMES = "|".join([*map(_LETTERS, ("password", "passwd", "secret", "token")), _LETTERS("api") + "_?" + _LETTERS("key")])
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Rules in their order: name, version, pattern, and the group and length that a match must have (group 0: the match).
#: A run of 20 or more is the same match as a run of any length that is then checked, as runs are maximal; an
#: assignment is matched first and checked after, since a short value is consumed all the same.
RULES = (
    ("assign", "1", ASSIGN, 2, 6),
    ("access", "1", r"AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", "1", r"[0-9a-f]{24,}", 0, 0),
)
SPAN = "array<struct<start:int,end:int>>"
#: Ledger columns.
LEDGER = f"blob string, rule string, rule_version string, spans {SPAN}"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def parts(text: Column, pattern: str, group: int = 0) -> Column:
    """What lies between leftmost non-overlapping matches, each match and its ``group``, in turn; null without a match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.when(text.rlike(pattern), F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), kept.alias("value")))


def spans(parts: Column, least: int = 0) -> Column:
    """Spans (code points, end exclusive) of the matches in a column of :func:`parts` whose group has ``least`` characters."""

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        grown = F.when(F.length(part["value"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    none = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    width = F.ceil(F.sqrt(F.size(parts))).cast("int")
    block = lambda i: F.aggregate(F.slice(parts, i * width + 1, width), zero, step)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / width).cast("int")), block)

    def join(acc: Column, one: Column) -> Column:
        moved = F.transform(one["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + one["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.when(F.size(parts) > 0, F.flatten(F.aggregate(blocks, start, join, lambda acc: acc["out"]))).otherwise(none)


def versions(docs: DataFrame) -> DataFrame:
    """doc_id and blob of every row: the history to be covered."""
    return docs.select("doc_id", address(F.col("text")).alias("blob"))


def scan_unseen(docs: DataFrame, history: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """New ledger rows: each distinct blob of ``history`` under each rule version that ``ledger`` lacks for it.

    One row of ``docs`` is read for each blob, the one of the smallest id: texts are
    joined to a narrow table by (id, blob), so copies of a text meet in no one task.
    """
    todo = history.groupBy("blob").agg(F.min("doc_id").alias("__first"))
    wanted = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(version).alias("rule_version")) for name, version, *_ in rules])
    if ledger is None:
        todo = todo.withColumn("__rules", F.array(*[F.lit(name) for name, *_ in rules]))
    else:
        todo = todo.withColumn("__pair", F.explode(wanted)).select("blob", "__first", "__pair.*")
        seen = ledger.select("blob", "rule", "rule_version").distinct()
        todo = todo.join(seen, ["blob", "rule", "rule_version"], "left_anti").groupBy("blob", "__first").agg(F.collect_set("rule").alias("__rules"))
    todo = todo.select(F.col("blob").alias("__blob"), "__first", "__rules").hint("shuffle_hash")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), address(F.col("text")).alias("blob"))
    texts = texts.join(todo, (texts["blob"] == todo["__blob"]) & texts["doc_id"].eqNullSafe(todo["__first"]))
    # parts are columns of their own, so a pattern is matched once a text
    found = texts.select("blob", "__rules", *[F.when(F.array_contains("__rules", name), parts(F.col("text"), pattern, group)).alias(f"__parts_{i}") for i, (name, _, pattern, group, _) in enumerate(rules)])
    rows = [
        F.struct(F.lit(name).alias("rule"), F.lit(version).alias("rule_version"), F.when(F.array_contains("__rules", name), spans(F.col(f"__parts_{i}"), least)).alias("spans"))
        for i, (name, version, _, _, least) in enumerate(rules)
    ]
    found = found.select("blob", F.explode(F.array(*rows)).alias("row")).select("blob", "row.*").where("spans IS NOT NULL")
    return found.dropDuplicates(["blob", "rule", "rule_version"])


def findings(history: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """``history`` with ``found``: array of (start, kind, end) by start, then rule, of its blob under the given rule versions."""
    ours = F.array(*[F.lit(f"{n}:{v}") for n, v, *_ in rules])
    kind = F.lit(None).cast("int")
    for i, (name, *_) in enumerate(rules):
        kind = F.when(F.col("rule") == name, i).otherwise(kind)
    hits = ledger.where((F.size("spans") > 0) & F.array_contains(ours, F.concat_ws(":", "rule", "rule_version")))
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))).alias("one"))
    hits = hits.groupBy(F.col("blob").alias("__blob")).agg(F.array_sort(F.flatten(F.collect_list("one"))).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return history.join(hits, history["blob"] == hits["__blob"], "left").drop("__blob").withColumn("found", F.coalesce("found", none))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, found) of every row of ``docs``, and the new ledger rows to append."""
    history = durable(versions(docs), "secret-versions")
    new = durable(scan_unseen(docs, history, ledger, rules), "secret-ledger")
    return findings(history, new if ledger is None else ledger.unionByName(new), rules), new


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    """Counts by rule and the spans as text, as the query returns them."""
    names = F.array(*[F.lit(n) for n, *_ in rules])
    said = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.withColumn("spans", said).select("doc_id", *[count(i).alias(f"n_{n}") for i, (n, *_) in enumerate(rules)], F.sha2("spans", 256).alias("base_sha256"), "spans")


def drop_leaking(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``docs`` without the rows whose text holds a secret.

    Leaking blobs are joined as a narrow table by hash, so texts move once and unsorted.
    """
    refuse(docs, "__")
    found, _ = scan(docs, ledger, rules)
    bad = found.where(F.size("found") > 0).select(F.col("blob").alias("__bad")).distinct().hint("shuffle_hash")
    return docs.join(bad, address(F.col("text")) == bad["__bad"], "left_anti")


def _oracle() -> str:
    def one(i: int, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        # gaps and hits alternate: a hit starts at the length of the gaps up to it and the hits before it
        return f"""SELECT r, doc_id, {i} AS kind, start, start + len(hit) AS fin FROM (
          SELECT r, doc_id, hit, value, sum(len(gap) + len(hit)) OVER (PARTITION BY r ORDER BY i) - len(hit) AS start FROM (
            SELECT r, doc_id, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS hit,
                   unnest(regexp_extract_all(text, '{p}', {group})) AS value, unnest(range(len(regexp_extract_all(text, '{p}')))) AS i
            FROM d WHERE regexp_matches(text, '{p}')) WHERE hit IS NOT NULL) WHERE len(value) >= {least}"""

    parts = " UNION ALL ".join(one(i, p, g, n) for i, (_, _, p, g, n) in enumerate(RULES))
    names = "[" + ", ".join(f"'{n}'" for n, *_ in RULES) + "]"
    counts = ", ".join(f"count(*) FILTER (kind = {i})::BIGINT AS n_{n}" for i, (n, *_) in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({parts}),
g AS (SELECT r, {counts}, string_agg({names}[kind + 1] || ':' || start::BIGINT || ':' || fin::BIGINT, ',' ORDER BY start, kind) AS spans FROM m GROUP BY r)
SELECT d.doc_id, {', '.join(f'coalesce(n_{n}, 0)::BIGINT AS n_{n}' for n, *_ in RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


ORACLE = _oracle()

"""Candidates: groups of transactions that shared entities connect within the window."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.causal import Past, sliced
from skein.operators.components import connected_components
from skein.operators.graph import chain_edges, edges, neighbours
from skein.plans.config import ENTITY_COLUMN, CandidateConfig


def causal_links(tx: DataFrame, config: CandidateConfig | None = None) -> DataFrame:
    """One row a pair (anchor, earlier transaction) with the entities that link it."""
    config = config or CandidateConfig()
    types = config.connectivity
    n = neighbours(tx, config)
    has = lambda t: F.max(F.when(F.col("entity_type") == t, F.col("entity_id")))
    g = n.groupBy(F.col("transaction_id").alias("anchor_transaction_id"), F.col("neighbour_id").alias("prior_transaction_id")).agg(F.max("delta_us").alias("delta_us"), *[has(t).alias(f"__{t}") for t in types])
    named = F.array_compact(F.array(*[F.when(F.col(f"__{t}").isNotNull(), t) for t in types]))
    cols = []
    for t in types:
        cols += [F.col(f"__{t}").isNotNull().alias(f"shares_{t}"), F.coalesce(f"__{t}", F.lit("")).alias(f"{t}_entity_id")]
    seconds = F.col("delta_us") / F.lit(1_000_000.0)
    return g.select("anchor_transaction_id", "prior_transaction_id", F.array_join(named, "|").alias("link_entity_types"), F.size(named).cast("long").alias("n_link_entity_types"), seconds.alias("delta_seconds"), (-seconds + 0.0).alias("age_seconds"), *cols)


def link_counts(tx: DataFrame, config: CandidateConfig | None = None) -> DataFrame:
    """``tx`` with n_links, n_links_multi and links_{type}: the earlier transactions that each is linked with.

    No pair is made: rows that share a set of entities are counted by one window a set,
    and pairs that share several are counted once by inclusion and exclusion.
    """
    config = config or CandidateConfig()
    sets = [c for k in range(1, len(config.connectivity) + 1) for c in combinations(config.connectivity, k)]
    out = sliced(tx, config.window_seconds, "__slice", "__halo")
    for first in config.connectivity:
        # all sets that begin with an entity type are counted in one exchange; rows without it are dealt over many partitions
        out = out.withColumn("__spread", F.when(F.col(ENTITY_COLUMN[first]).isNull(), F.pmod(F.col("ok"), F.lit(4096)))).repartition(ENTITY_COLUMN[first], "__slice", "__spread")
        for c in [c for c in sets if c[0] == first]:
            past = Past(list(c), config.window_seconds, "__slice", "__spread")
            # rows of the same time first: their order serves the longer frame as well
            out = out.withColumn("__ties", F.count(F.lit(1)).over(past.ties)).withColumn("__" + "_".join(c), F.when(past.known, F.coalesce(F.count(F.lit(1)).over(past.earlier), F.lit(0)) + F.col("__ties")).otherwise(0))
    out = out.where("NOT __halo")
    n = {k: [F.col("__" + "_".join(c)) for c in sets if len(c) == k] for k in range(1, len(config.connectivity) + 1)}
    add = lambda sign: sum((sign(k) * x for k, cols in n.items() for x in cols), F.lit(0)).cast("long")
    # of a pair that shares j types, the sets of k among them are C(j, k)
    out = out.withColumns({"n_links": add(lambda k: (-1) ** (k + 1)), "n_links_multi": add(lambda k: (k - 1) * (-1) ** k), **{f"links_{t}": F.col(f"__{t}").cast("long") for t in config.connectivity}})
    return out.drop("__slice", "__halo", "__spread", "__ties", *["__" + "_".join(c) for c in sets])


def explode_links(links: DataFrame, config: CandidateConfig | None = None) -> DataFrame:
    """One row a link and entity type."""
    types = (config or CandidateConfig()).connectivity
    rows = F.filter(F.array(*[F.struct(F.lit(t).alias("link_entity_type"), F.col(f"{t}_entity_id").alias("link_entity_id"), F.col(f"shares_{t}").alias("on")) for t in types]), lambda x: x["on"])
    return links.select("anchor_transaction_id", "prior_transaction_id", F.explode(rows).alias("x")).select("anchor_transaction_id", "prior_transaction_id", "x.link_entity_type", "x.link_entity_id")


def causal_candidate(links: DataFrame) -> DataFrame:
    """Each anchor with the priors it could see, sorted, joined by |."""
    g = links.groupBy("anchor_transaction_id").agg(F.sort_array(F.collect_set("prior_transaction_id")).alias("p"), F.min("delta_seconds").alias("oldest_delta"))
    return g.select("anchor_transaction_id", F.size("p").cast("long").alias("n_priors"), F.array_join("p", "|").alias("prior_ids"), "oldest_delta")


def components(tx: DataFrame, config: CandidateConfig | None = None) -> DataFrame:
    """(transaction_id, ok, ts_us, root): root is the causal key of the component's first transaction."""
    config = config or CandidateConfig()
    e = chain_edges(tx, config.window_seconds, config.connectivity).select(F.col("src_ok").alias("src"), F.col("dst_ok").alias("dst"))
    cc = connected_components(e).select(F.col("node").alias("ok"), F.col("component").alias("root"))
    return tx.select("transaction_id", "ok", "ts_us").join(cc, "ok", "left").withColumn("root", F.coalesce("root", "ok"))


def assignments(comp: DataFrame, config: CandidateConfig | None = None) -> DataFrame:
    """transaction_id, ts_us, ok, candidate_id, candidate_size, is_isolated.

    Candidates are numbered by their first transaction: counts by a million positions are
    summed, then numbered within those.
    """
    config = config or CandidateConfig()
    roots = comp.groupBy("root").agg(F.count(F.lit(1)).alias("candidate_size"))
    roots = roots.withColumn("d", F.shiftright("root", 20))
    spans = roots.groupBy("d").count()
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("d", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    roots = roots.withColumn("i", F.row_number().over(Window.partitionBy("d").orderBy("root"))).join(spans, "d")
    width = F.greatest(F.lit(6), F.length(F.col("n").cast("string")))
    number = (F.col("i") + F.col("before")).cast("string")
    named = F.concat(F.lit(config.prefix + "-"), F.when(F.length(number) < width, F.expr("lpad(CAST(i + before AS STRING), greatest(6, length(CAST(n AS STRING))), '0')")).otherwise(number))
    roots = roots.select("root", "candidate_size", named.alias("candidate_id"))
    out = comp.join(roots, "root").select("transaction_id", "ts_us", "ok", "candidate_id", "candidate_size", (F.col("candidate_size") == 1).alias("is_isolated"))
    return out if config.keep_singletons else out.where("candidate_size > 1")


def candidate_frame(tx: DataFrame, assigned: DataFrame, config: CandidateConfig | None = None, list_ids: bool = False) -> DataFrame:
    """One row a candidate: size, span, links by type, distinct entities.

    ``list_ids`` adds all ids of bins and transactions, each as one string: for small
    candidates at the edge; at scale the members are the rows of ``assigned``.
    """
    t = assigned.select("transaction_id", "candidate_id", "candidate_size").join(link_counts(tx, config), "transaction_id")
    ids = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "|")
    base = t.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("size"), F.min("ts_us").alias("first_ts_us"), F.max("ts_us").alias("last_ts_us"),
        *[F.count_distinct(ENTITY_COLUMN[e]).alias(f"distinct_{e}s") for e in ("card", "device", "ip", "merchant", "bin")],
        F.sum("n_links").alias("link_edge_count"), F.sum("n_links_multi").alias("links_multi_entity"), *[F.sum(f"links_{e}").alias(f"links_{e}") for e in ("card", "device", "ip")],
        *([ids("bin").alias("bin_ids_context"), ids("transaction_id").alias("transaction_ids")] if list_ids else []),
    )
    return base.withColumn("time_span_seconds", (F.col("last_ts_us") - F.col("first_ts_us")) / F.lit(1_000_000.0)).withColumn("is_isolated", F.col("size") == 1)


def overlap(tx: DataFrame, assigned: DataFrame) -> DataFrame:
    """Candidates with entities that two or more of their transactions use: counts, ids and the most of one, by type."""
    t = assigned.where("candidate_size > 1").select("transaction_id", "candidate_id")
    e = edges(tx, ("card", "device", "ip")).join(t, "transaction_id").groupBy("candidate_id", "entity_type", "entity_id").count().where("count > 1")
    of = lambda t, c: F.when(F.col("entity_type") == t, F.col(c))
    cols = []
    for t in ("card", "device", "ip"):
        cols += [F.count(of(t, "entity_id")).alias(f"n_shared_{t}s"), F.array_join(F.sort_array(F.collect_set(of(t, "entity_id"))), "|").alias(f"shared_{t}_ids"), F.coalesce(F.max(of(t, "count")), F.lit(0)).alias(f"max_transactions_per_shared_{t}")]
    return e.groupBy("candidate_id").agg(*cols)


def summary(assigned: DataFrame) -> DataFrame:
    """One row over candidates."""
    c = assigned.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("size"), ((F.max("ts_us") - F.min("ts_us")) / F.lit(1_000_000.0)).alias("span"))
    multi = F.when(F.col("size") > 1, F.col("span"))
    return c.agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("size") > 1).alias("n_multi"), F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).cast("long").alias("n_multi_transactions"),
        F.max("size").alias("max_size"), F.percentile(F.when(F.col("size") > 1, F.col("size")), F.lit(0.5)).alias("median_multi_size"), F.round(F.percentile(multi, F.lit(0.5)), 6).alias("median_multi_span"),
    )

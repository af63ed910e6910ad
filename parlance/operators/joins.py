"""Interval and vector joins: word alignment, error rates, speaker identification, centroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distance up to which two voices are one.
SAME_VOICE = 0.45
#: Numbers of all exemplars' vectors up to which all pairs are compared as products of blocks.
FEW_NUMBERS = 8_000_000


def aligned(words: DataFrame, turns: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """Each word's speaker: the turn with the largest overlap, else the nearest, the earliest of equals.

    Words and turns meet only where their minutes do; words that overlap no
    turn are matched to the last turn before and the first after them, found
    with running windows. No call's words are paired with all its turns.
    """
    t = turns.select("call_id", "turn", F.col("speaker_id").alias("turn_speaker"), F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"))
    spans = lambda s, e: F.explode(F.sequence(F.floor(s / bin_ms), F.floor(F.greatest(e, s) / bin_ms)))
    near = words.withColumn("bin", spans(F.col("start_ms"), F.col("end_ms"))).join(t.withColumn("bin", spans(F.col("ts"), F.col("te"))), ["call_id", "bin"])
    overlap = F.greatest(F.least("te", "end_ms") - F.greatest("ts", "start_ms"), F.lit(0))
    near = near.withColumn("overlap", overlap).where("overlap > 0")
    best = F.max_by(F.struct("turn_speaker", "overlap"), F.struct("overlap", (-F.col("ts")).alias("s"), (-F.col("turn")).alias("n")))
    hit = near.groupBy("call_id", "sequence", "pos").agg(best.alias("best"))
    rows = words.join(hit, ["call_id", "sequence", "pos"], "left")
    missed = rows.where("best IS NULL").select("call_id", "sequence", "pos", "start_ms", "end_ms")
    # turns before and after, by one pass over both in order of time
    mixed = missed.select("call_id", F.col("start_ms").alias("at"), F.lit(1).alias("is_word"), "sequence", "pos", "start_ms", "end_ms", F.lit(None).cast("struct<te:bigint,s:bigint,n:bigint,who:int>").alias("turn_end"), F.lit(None).cast("struct<ts:bigint,n:bigint,who:int>").alias("turn_start"))
    null = lambda k: F.lit(None).cast(k)
    begin = t.select("call_id", F.col("ts").alias("at"), F.lit(0).alias("is_word"), null("bigint").alias("sequence"), null("int").alias("pos"), null("bigint").alias("start_ms"), null("bigint").alias("end_ms"),
        F.struct(F.col("te").cast("bigint").alias("te"), (-F.col("ts")).cast("bigint").alias("s"), (-F.col("turn")).cast("bigint").alias("n"), F.col("turn_speaker").cast("int").alias("who")).alias("turn_end"),
        F.struct(F.col("ts").cast("bigint").alias("ts"), F.col("turn").cast("bigint").alias("n"), F.col("turn_speaker").cast("int").alias("who")).alias("turn_start"))
    w = Window.partitionBy("call_id").orderBy("at", "is_word", "sequence", "pos")
    back = Window.partitionBy("call_id").orderBy(F.desc("at"), F.desc("is_word"), F.desc("sequence"), F.desc("pos"))
    both = mixed.withColumn("sequence", F.col("sequence").cast("bigint")).unionByName(begin)
    both = both.withColumn("before", F.max("turn_end").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.min("turn_start").over(back.rowsBetween(Window.unboundedPreceding, -1))).where("is_word = 1")
    d1 = F.greatest(F.col("start_ms") - F.col("before.te"), F.lit(0))
    d2 = F.greatest(F.col("after.ts") - F.col("end_ms"), F.lit(0))
    who = F.when(F.col("before").isNull(), F.col("after.who")).when(F.col("after").isNull() | (d1 <= d2), F.col("before.who")).otherwise(F.col("after.who"))
    far = both.select("call_id", "sequence", "pos", who.alias("nearest"))
    return rows.join(far, ["call_id", "sequence", "pos"], "left").select("call_id", "sequence", "pos", "word", F.coalesce("best.turn_speaker", "nearest").cast("int").alias("turn_speaker"), F.coalesce("best.overlap", F.lit(0)).cast("bigint").alias("overlap_ms"))


def overlaps(reference: DataFrame, hypothesis: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """Milliseconds that each pair of speakers (reference, hypothesis) shares in a call."""
    spans = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_ms), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / bin_ms)))
    r = reference.select("call_id", F.col("speaker_id").alias("ref_speaker"), F.col("start_ms").alias("rs"), F.col("end_ms").alias("re")).withColumn("bin", spans("rs", "re"))
    h = hypothesis.select("call_id", F.col("speaker_id").alias("hyp_speaker"), F.col("start_ms").alias("hs"), F.col("end_ms").alias("he")).withColumn("bin", spans("hs", "he"))
    # each minute's share of the overlap, so that a pair in two minutes counts once
    low, high = F.col("bin") * bin_ms, (F.col("bin") + 1) * bin_ms
    shared = F.least("re", "he", high) - F.greatest("rs", "hs", low)
    return r.join(h, ["call_id", "bin"]).withColumn("ms", shared).where("ms > 0").groupBy("call_id", "ref_speaker", "hyp_speaker").agg(F.sum("ms").alias("overlap_ms"))


def greedy_matches(pairs: pd.DataFrame) -> pd.DataFrame:
    """Pairs of speakers in falling order of overlap, each speaker once."""
    out, refs, hyps = [], set(), set()
    for row in pairs.sort_values(["overlap_ms", "ref_speaker", "hyp_speaker"], ascending=[False, True, True]).itertuples():
        if row.ref_speaker not in refs and row.hyp_speaker not in hyps:
            refs.add(row.ref_speaker)
            hyps.add(row.hyp_speaker)
            out.append((row.call_id, row.ref_speaker, row.hyp_speaker, row.overlap_ms))
    return pd.DataFrame(out, columns=["call_id", "ref_speaker", "hyp_speaker", "overlap_ms"])


def error_rate(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Missed, false and confused time of each call, and their share of the reference's time.

    A call's matrix has speakers x speakers rows, so the greedy match sees one
    small group at a time.
    """
    shared = overlaps(reference, hypothesis)
    matched = shared.groupBy("call_id").applyInPandas(greedy_matches, shared.schema).groupBy("call_id").agg(F.sum("overlap_ms").alias("right_ms"))
    total = lambda df, name: df.groupBy("call_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(name))
    rows = total(reference, "reference_ms").join(total(hypothesis, "hypothesis_ms"), "call_id", "left").join(shared.groupBy("call_id").agg(F.sum("overlap_ms").alias("both_ms")), "call_id", "left").join(matched, "call_id", "left").na.fill(0)
    missed, false = F.greatest(F.col("reference_ms") - F.col("both_ms"), F.lit(0)), F.greatest(F.col("hypothesis_ms") - F.col("both_ms"), F.lit(0))
    confused = F.greatest(F.col("both_ms") - F.col("right_ms"), F.lit(0))
    rate = F.when(F.col("reference_ms") > 0, F.round((missed + false + confused) / F.col("reference_ms"), 6)).otherwise(F.lit(0.0))
    return rows.select("call_id", "reference_ms", missed.alias("missed_ms"), false.alias("false_ms"), confused.alias("confused_ms"), rate.alias("der"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 (same) to 2; 1 for vectors of other lengths, empty or next to zero."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    bad = (F.size(a) != F.size(b)) | (F.size(a) == 0) | (na < 1e-6) | (nb < 1e-6)
    return F.when(bad, F.lit(1.0)).otherwise(F.greatest(F.least(1 - dot(a, b) / (na * nb), F.lit(2.0)), F.lit(0.0)))


def normalised_vector(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n < 1e-6, a).otherwise(F.transform(a, lambda x: x / n))


def unit(c: str) -> Column:
    """A vector brought to length 1; an empty one for a vector next to zero, which is like no other."""
    n = F.sqrt(dot(F.col(c), F.col(c)))
    return F.when(n < 1e-6, F.array().cast("array<double>")).otherwise(F.transform(F.col(c), lambda x: x / n))


#: Width of a ring about a pivot, in radians, and what a bound gives way to rounding.
RING, SLACK = 0.05, 1e-6


def pivots_of(exemplars: DataFrame, most: int) -> DataFrame:
    """A row for each organisation and length of vectors: up to ``most`` of its exemplars, those with the least hashes.

    A cut on the hash leaves some four times as many, so that none but these
    come together.
    """
    group = ["organization_id", "size"]
    sizes = exemplars.groupBy(*group).agg(F.count("*").alias("n"))
    h = F.pmod(F.xxhash64("exemplar"), F.lit(2**32))
    few = exemplars.join(sizes, group).where(h * F.col("n") <= F.lit(2**32 * 4 * most))
    order = Window.partitionBy(*group).orderBy(h, "exemplar")
    few = few.withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= most)
    return few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("r_", "exemplar", F.col("known").alias("v")))).alias("pivots"))


def candidates(probes: DataFrame, exemplars: DataFrame, limit: float, pivots: int = 64) -> DataFrame:
    """Pairs (id, exemplar) that have to be compared to find each probe's nearest exemplar within ``limit`` (below 1), and no other.

    Angles between unit vectors meet the triangle inequality. An exemplar stands
    in the cell of its nearest pivot, in a ring by its angle to it. A probe has
    no nearer exemplar than its nearest pivot, which is one; so with that angle
    as its reach it needs the rings between its own angle less and plus the
    reach, of the cells that have such rings. Vectors of other lengths or next
    to zero are at distance 1 and need none.
    """
    turned = lambda a, b: F.acos(F.greatest(F.least(dot(a, b), F.lit(1.0)), F.lit(-1.0)))
    group = ["organization_id", "size"]
    e = exemplars.withColumn("size", F.size("known")).where("size > 0")
    centres = pivots_of(e, pivots)
    few = centres.agg(F.coalesce(F.sum(F.size("pivots") * F.col("size")), F.lit(0)).alias("n")).first().n <= FEW_NUMBERS
    sent = lambda df: F.broadcast(df) if few else df
    near = e.join(sent(centres), group).withColumn("angles", F.transform("pivots", lambda p: turned(F.col("known"), p["v"])))
    near = near.withColumn("cell", F.array_position("angles", F.array_min("angles")).cast("int")).withColumn("angle", F.array_min("angles"))
    near = near.select(*group, "exemplar", "name", "known", "cell", "angle", F.floor(F.col("angle") / RING).alias("ring"))
    reach = near.groupBy(*group, "cell").agg(F.min("ring").alias("lo"), F.max("ring").alias("hi"))
    bounds = reach.groupBy(*group).agg(F.collect_list(F.struct("cell", "lo", "hi")).alias("cells"))
    p = probes.withColumn("size", F.size("own")).where("size > 0").join(sent(centres.join(bounds, group)), group)
    p = p.withColumn("angles", F.transform("pivots", lambda x: turned(F.col("own"), x["v"])))
    others = F.array_min(F.filter(F.zip_with("angles", "pivots", lambda a, x: F.when(x["exemplar"] != F.col("id"), a)), lambda a: a.isNotNull()))
    p = p.withColumn("reach", F.least(F.coalesce(others, F.lit(3.2)), F.acos(F.lit(1.0 - limit))) + SLACK)
    ring = lambda x: F.floor(x / RING)
    of = lambda c: F.element_at("angles", c["cell"])
    spans = F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), F.greatest(c["lo"], ring(of(c) - F.col("reach"))).alias("a"), F.least(c["hi"], ring(of(c) + F.col("reach"))).alias("b")))
    p = p.select(*group, "id", "own", "angles", "reach", F.explode(F.filter(spans, lambda x: x["a"] <= x["b"])).alias("s"))
    p = p.select(*group, "id", "own", "reach", F.col("s.cell").alias("cell"), F.element_at("angles", F.col("s.cell")).alias("at"), F.explode(F.sequence("s.a", "s.b")).alias("ring"))
    rows = p.join(near, [*group, "cell", "ring"])
    return rows.where((F.abs(F.col("at") - F.col("angle")) <= F.col("reach")) & (F.col("id") != F.col("exemplar"))).select("organization_id", "id", "own", "exemplar", "name", "known")


def identified(probes: DataFrame, exemplars: DataFrame, limit: float = SAME_VOICE) -> DataFrame:
    """Each probe's nearest named exemplar of its own organisation within ``limit``, the first of equals.

    Voice prints don't cross organisations: the organisation is the join key.
    Vectors are brought to length 1 once. Up to a number of exemplars, and at a
    limit of 1 or more, where vectors that can't be compared match too, all
    pairs are compared as products of blocks (``nearest_in_blocks``); else only
    ``candidates`` are, which gives the same.
    """
    e = exemplars.where("name IS NOT NULL").select("organization_id", F.col("id").alias("exemplar"), "name", unit("embedding").alias("known"))
    p = probes.select("organization_id", "id", unit("embedding").alias("own"))
    numbers = e.agg(F.coalesce(F.sum(F.size("known")), F.lit(0)).alias("n")).first().n
    if numbers > FEW_NUMBERS and limit < 1:
        return nearest(candidates(p, e, limit).where("id <> exemplar"), limit)
    return nearest(nearest_in_blocks(p, e), limit)


#: Vectors in a block, and what a product of blocks may differ by from a sum in order.
BLOCK, ROUNDING = 4096, 1e-9


def nearest_in_blocks(probes: DataFrame, exemplars: DataFrame) -> DataFrame:
    """Pairs among which each probe's nearest exemplar is, the first of equals too: those that come next to it in a block's product.

    Probes and exemplars are dealt out in blocks by the hash of their ids, and
    each block of one meets each of the other of its organisation, whatever the
    number of either. A task holds two blocks at a time.
    """
    n = lambda df, name: df.groupBy("organization_id").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    parts = n(probes, "ps").join(n(exemplars, "es"), "organization_id")

    def dealt(df: DataFrame, of: str, key: str, own: str, other: str, mine: str, theirs: str):
        rows = df.withColumnRenamed("organization_id", of).join(parts.withColumnRenamed("organization_id", of), of)
        rows = rows.withColumn(mine, F.pmod(F.xxhash64(key), F.col(own))).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        return rows.drop("ps", "es").groupBy(of, f"{of[0]}p", f"{of[0]}e")

    p = dealt(probes, "p_of", "id", "ps", "es", "pp", "pe")
    e = dealt(exemplars, "e_of", "exemplar", "es", "ps", "ee", "ep")
    schema = f"organization_id {dict(probes.dtypes)['organization_id']}, id {dict(probes.dtypes)['id']}, own array<double>, exemplar {dict(exemplars.dtypes)['exemplar']}, name string, known array<double>"
    return p.cogroup(e).applyInArrow(_close, schema)


def _close(own: pa.Table, known: pa.Table) -> pa.Table:
    """For each probe of a block the exemplars that are as near as any of the block, by rounding."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    a, b = own.column("own").combine_chunks(), known.column("known").combine_chunks()
    ids, others = own.column("id").to_numpy(), known.column("exemplar").to_numpy()
    na, nb = (pc.fill_null(x.value_lengths(), -1).to_numpy() for x in (a, b))
    for size in np.unique(na):  # the others are at distance 1, all alike: the first of them counts
        at, to = np.flatnonzero(na == size), np.flatnonzero((nb == size) & (size > 0))
        far = np.flatnonzero((nb != size) | (size <= 0))
        far = far[np.argsort(others[far], kind="stable")[:2]]
        for k in range(len(far)):
            left.append(at)
            right.append(np.full(len(at), far[k]))
        if len(to):
            to = to[np.argsort(others[to], kind="stable")]
            y = np.stack([b[int(i)].values.to_numpy() for i in to])
            # of equal vectors the first two, since one may be the probe itself
            copies = pd.Series([v.tobytes() for v in y])
            few = (copies.groupby(copies).cumcount() < 2).to_numpy()
            to, y = to[few], y[few]
            for start in range(0, len(at), 512):
                mine = at[start : start + 512]
                like = np.nan_to_num(np.stack([a[int(i)].values.to_numpy() for i in mine]) @ y.T, nan=-1.0)
                like[ids[mine][:, None] == others[to][None, :]] = -np.inf
                i, j = np.nonzero(like >= np.clip(like.max(axis=1), -1, 1)[:, None] - ROUNDING)
                left.append(mine[i])
                right.append(to[j])
    left, right = np.concatenate(left), np.concatenate(right)
    apart = ids[left] != others[right]
    mine, theirs = own.take(pa.array(left[apart])), known.take(pa.array(right[apart]))
    return pa.table([mine.column("p_of"), mine.column("id"), mine.column("own"), theirs.column("exemplar"), theirs.column("name"), theirs.column("known")], ["organization_id", "id", "own", "exemplar", "name", "known"])


def nearest(pairs: DataFrame, limit: float) -> DataFrame:
    """Of compared pairs each probe's nearest exemplar within ``limit``, the first of equals."""
    near = F.when((F.size("own") == F.size("known")) & (F.size("own") > 0), F.greatest(F.least(1 - dot(F.col("own"), F.col("known")), F.lit(2.0)), F.lit(0.0))).otherwise(F.lit(1.0))
    rows = pairs.withColumn("distance", near).where(F.col("distance") <= limit)
    best = F.min_by(F.struct("exemplar", "name", "distance"), F.struct("distance", "exemplar"))
    return rows.groupBy("id").agg(best.alias("b")).select("id", "b.exemplar", "b.name", F.round("b.distance", 6).alias("distance"))


def centroids(rows: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """The mean vector of each key, element by element: sums are combined before the shuffle."""
    flat = rows.select(key, F.posexplode(embedding).alias("pos", "x"))
    means = flat.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def absorbed(rows: DataFrame, group: str, least: int = 6) -> DataFrame:
    """Within each ``group``, members of labels with fewer than ``least`` rows move to the nearest large label's centroid."""
    sizes = rows.groupBy(group, "label").agg(F.count("*").alias("n"))
    place = F.struct(group, "label")
    big = rows.join(sizes.where(F.col("n") >= least), [group, "label"], "left_semi").withColumn("of", place)
    large = centroids(big, "of").select(F.col("of")[group].alias(group), F.col("of.label").alias("new"), "centroid")
    small = rows.join(sizes.where(F.col("n") < least), [group, "label"], "left_semi")
    moved = small.join(large, group).withColumn("d", cosine_distance(F.col("embedding"), F.col("centroid")))
    moved = moved.groupBy("id").agg(F.min_by("new", F.struct("d", "new")).alias("new"))
    return rows.join(moved, "id", "left").select("id", group, F.coalesce("new", "label").alias("label"))


def relabelled(rows: DataFrame, names: dict[int, str]) -> DataFrame:
    """Segments with the given names for their speakers."""
    label = F.lit(None).cast("string")
    for speaker, name in names.items():
        label = F.when(F.col("speaker_id") == speaker, name).otherwise(label)
    return rows.withColumn("speaker_label", label)

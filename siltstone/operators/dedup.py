"""Fingerprints, order-dependent de-duplication and similarity of shingle sets.

The greedy rules ("drop a row if an earlier row that was kept has its id or fingerprint", "... is similar") are worked
out in rounds over all rows: a row that comes first among what is left of everything it competes with is kept, and what
competes with a kept row goes. No group is gathered, however large; what is left in the end, if it is little, is gone
through by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import normalize_text
from siltstone.operators import set_join
from siltstone.sources.batches import modest_batches
from siltstone.sources.tables import drop_settled, settle


def claim_fingerprint(location: Column | str, incident: Column | str, damages: Column, statements: Column, label: Column | None = None) -> Column:
    """sha256 of the normalised claim; damages sorted, statements in order; with the label if given."""
    told = F.transform(statements, lambda s: F.concat_ws("::", normalize_text(s["role"]), normalize_text(s["vehicle"]), normalize_text(s["text"])))
    harm = F.array_join(F.array_sort(F.transform(damages, normalize_text)), "|")
    parts = [normalize_text(location), normalize_text(incident), *([normalize_text(label)] if label is not None else []), harm, F.array_join(told, "||")]
    return F.sha2(F.concat_ws("||", *parts).cast("binary"), 256)


def first_by(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of each key's rows the first; every other column goes with it."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("r")).select(key, "r.*")


#: Rows that one task settles in order, where no more are left.
REMAINDER = 100_000
#: Rounds' results are written together after so many, so that plans stay small.
MERGE = 16


class _Parts:
    """The union of what rounds found."""

    def __init__(self):
        self.parts: list[DataFrame] = []

    def add(self, df: DataFrame) -> None:
        self.parts.append(df)
        if len(self.parts) >= MERGE:
            self.parts = [settle(self.all(), "merged")]

    def all(self) -> DataFrame | None:
        out = None
        for x in self.parts:
            out = x if out is None else out.unionByName(x)
        return out


def _kept_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (pos, id, fp) in order those whose id and fp no kept one before has."""
    ids, fps = set(), set()
    for batch in batches:
        good = []
        for i, (own, fp) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if own not in ids and fp not in fps:
                ids.add(own)
                fps.add(fp)
                good.append(i)
        yield batch.take(pa.array(good, pa.int64()))


def greedy_dedup(rows: DataFrame) -> DataFrame:
    """rows (pos, id, fp) -> (pos, outcome): kept, id_duplicate (a kept row before has the id) or fp_duplicate. pos tells
    rows apart and orders them; an empty or null id is no one's duplicate. Rows that were dropped register nothing."""
    rows = rows.select("pos", F.when(F.col("id") != "", F.concat(F.lit("i"), F.col("id"))).otherwise(F.concat(F.lit("p"), F.col("pos"))).alias("id"), "fp")
    rows = settle(rows.withColumn("id", F.coalesce("id", F.concat(F.lit("p"), F.col("pos")))), "rows")
    left, found = rows, _Parts()
    while True:  # each round keeps at least the first row that is left
        ids, fps = left.groupBy("id").agg(F.min("pos").alias("mi")), left.groupBy("fp").agg(F.min("pos").alias("mf"))
        now = settle(left.join(ids, "id").join(fps, "fp").where("pos = mi and pos = mf").select("pos", "id", "fp"), "kept")
        found.add(now)
        left = settle(left.join(now.select("id"), "id", "left_anti").join(now.select("fp"), "fp", "left_anti").select("pos", "id", "fp"), "left")
        size = left.count()
        if 0 < size <= REMAINDER:  # one task goes through the rest in order
            found.add(settle(left.repartition(1).sortWithinPartitions("pos").mapInArrow(_kept_in_order, left.schema), "kept"))
        if size <= REMAINDER:
            break
    kept = found.all()
    by_id = kept.select("id", F.col("pos").alias("ki"))
    out = rows.join(kept.select("pos", F.lit(True).alias("k")), "pos", "left").join(by_id, "id", "left")
    return out.select("pos", F.when(F.col("k"), "kept").when(F.col("ki") < F.col("pos"), "id_duplicate").otherwise("fp_duplicate").alias("outcome"))


def shingles(c: Column | str, k: int = 3) -> Column:
    """Distinct k-word shingles of lower-case words of a-z, 0-9, < and >; of fewer words the whole; of none, empty."""
    tokens = F.regexp_extract_all(normalize_text(c), F.lit("[a-z0-9<>]+"), F.lit(0))
    runs = F.flatten(F.transform(F.array(tokens), lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))))
    return F.array_distinct(F.array_remove(runs, ""))


#: 1 for the bytes of shingles' words in lower-case texts.
BY_CLAIM = np.zeros(256, np.uint8)
BY_CLAIM[list(b"abcdefghijklmnopqrstuvwxyz0123456789<>")] = 1


def _classed(sets: DataFrame, percent: int) -> tuple:
    """set_join.prepared's results for sets (id, grp, sh), and (cls, id, grp) of the classes, by the smallest id."""
    rule = set_join.Rule(3, BY_CLAIM, grouped=True)
    docs = sets.select(F.lit(0).alias("doc_id"), F.col("sh").alias("text"), F.xxhash64(F.col("grp").cast("string")).alias("group_key"), "id", "grp")
    docs, common, slim, live = set_join.prepared(docs, rule, percent, 4, ("id", "grp"), sketch=True)
    names = settle(slim.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first("grp").alias("grp")), "classes")
    sketches = settle(slim.where("cls is not null").select("cls", "n", "sketch").join(live.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "sketches")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = settle(set_join.able(pairs, sketches, percent), "pairs")
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        segments = set_join.fetched(ends, docs, rule, common, 8)
        out = settle(set_join.overlaps(pairs, segments, percent), "links")
        drop_settled(pairs, segments)
        return out

    return slim, live, names, linked


def _whole_percent(threshold: float) -> int:
    return int(threshold * 100 + 1e-9)


def similar_sets(sets: DataFrame, threshold: float = 0.82) -> DataFrame:
    """sets (id, grp, sh) -> (grp, id_a, id_b, common, total): pairs within a group with Jaccard of threshold or more
    between different sets. sh: the shingles, or a lower-case text whose shingles they are; of a text nothing is stored
    but the prefix of its set. Rows of one and the same set are one class, that of the smallest id; only classes are
    paired, so copies make no pairs. Candidates share one of each set's rarest shingles, as many as a similar set cannot
    all lack (exact, without a cap). Rows whose group is null are in no pair."""
    with modest_batches(sets.sparkSession):
        _, live, names, linked = _classed(sets, _whole_percent(threshold))
        links = linked(set_join.candidates(live, _whole_percent(threshold)))
    side = lambda k: names.where("grp is not null").select(F.col("cls").alias(k), F.col("id").alias(f"id_{k}"), *(["grp"] if k == "a" else []))
    both = links.withColumn("total", F.col("na") + F.col("nb") - F.col("o")).where(F.col("o") >= F.col("total") * threshold - 1e-9).join(side("a"), "a").join(side("b"), "b")
    return both.select("grp", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.col("o").alias("common"), "total")


def set_key(sh: str) -> Column:
    """One and the same text for equal sets."""
    return F.sha2(F.array_join(F.array_sort(sh), "\n").cast("binary"), 256)


#: Rows of a list to a key, where lists are joined with themselves.
LIST_ROWS = 256


def _similar(classes: DataFrame, threshold: float) -> DataFrame:
    """classes (grp, id, sh) of different sets -> (grp, id_a, id_b, common, total). A pair's first common shingle, in the
    order of commonness, stands early enough in both sets to leave what they must share, so pairs are only taken from
    lists where it does; long lists are spread over keys."""
    classes = settle(classes.withColumn("sh", F.transform("sh", lambda x: F.xxhash64(x))).withColumn("n", F.size("sh")), "classes")
    rows = classes.select("grp", "id", "n", F.explode("sh").alias("h"))
    counts = rows.groupBy("grp", "h").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("grp", "id").orderBy("df", "h"))
    prefix = rows.join(counts, ["grp", "h"]).withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).where("df > 1")
    prefix = settle(prefix.select("grp", "id", "n", "h", (F.col("n") - F.col("rank") + 1).alias("left"), F.floor(F.col("df") / LIST_ROWS).cast("int").alias("keys")), "prefix")
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "left")]
    a = prefix.select("grp", "h", F.pmod(F.xxhash64("id"), F.col("keys") + 1).cast("int").alias("salt"), *side("a"))
    b = prefix.select("grp", "h", F.explode(F.sequence(F.lit(0), "keys")).alias("salt"), *side("b"))
    need = threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6
    found = a.join(b, ["grp", "h", "salt"]).where("id_a < id_b").where(F.least("left_a", "left_b") >= need)
    found = found.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9).select("grp", "id_a", "id_b").distinct()
    both = found.join(classes.select("grp", F.col("id").alias("id_a"), F.col("sh").alias("sa")), ["grp", "id_a"]).join(classes.select("grp", F.col("id").alias("id_b"), F.col("sh").alias("sb")), ["grp", "id_b"])
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb"))).withColumn("total", F.size("sa") + F.size("sb") - F.col("common"))
    return both.where(F.col("common") >= F.col("total") * threshold - 1e-9).select("grp", "id_a", "id_b", F.col("common").cast("long"), F.col("total").cast("long"))


def claim_rejects(statements: DataFrame, threshold: float = 0.82) -> DataFrame:
    """statements (pos, role, text, before) of claims in order of pos -> (pos, kept): a claim is kept unless one of its
    statements is similar to one of the same role in a claim kept before it. Its own statements are not compared. Claims
    with before = true were there already: they are kept, and come first. A claim without statements has no row here;
    statements without a word are similar to none. Equal statements are one class, so copies make no pairs.
    """
    sets = statements.select("pos", "before", F.coalesce("role", F.lit("")).alias("grp"), shingles("text").alias("sh"))
    sets = settle(sets.withColumn("id", F.when(F.size("sh") > 0, F.sha2(F.concat_ws("\n", "grp", set_key("sh")).cast("binary"), 256))), "sets")
    classes = sets.where("id is not null").groupBy("grp", "id").agg(F.first("sh").alias("sh"))
    links = _similar(classes, threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    claims = sets.groupBy("pos").agg(F.max("before").alias("before"))
    gone = greedy_rejects(sets.where("id is not null").select("pos", F.col("id").alias("cls"), "before").distinct(), links)
    return claims.join(gone.withColumn("gone", F.lit(True)), "pos", "left").select("pos", F.col("gone").isNull().alias("kept"))


def greedy_rejects(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (pos, cls, before), links (a, b) between different classes -> (pos) of those rejected: in order of pos, one
    that has a class of a kept one before it, or a class linked to such a class. Those with before = true are kept.

    In rounds over all members: what comes first in the neighbourhood of each of its classes is kept, what has a class
    there goes. A remainder of REMAINDER rows or fewer is settled by one task, so that long chains take no long rounds.
    """
    near = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near")

    def around(cls: DataFrame) -> DataFrame:
        return cls.unionByName(cls.join(near, cls["cls"] == near["a"]).select(F.col("b").alias("cls"))).distinct()

    found = _Parts()
    kept = members.where("before").select("cls").distinct()
    left = members.where("not before").select("pos", "cls")
    while True:
        hit = settle(left.join(around(kept), "cls", "left_semi").select("pos").distinct(), "rejected")
        found.add(hit)
        left = settle(left.join(hit, "pos", "left_anti"), "left")
        size = left.count()
        if not size:
            return found.all()
        own = near.join(left.select(F.col("cls").alias("a")).distinct(), "a", "left_semi")
        if size <= REMAINDER and own.limit(REMAINDER + 1).count() <= REMAINDER:
            found.add(_in_order(left, own))
            return found.all()
        first = left.groupBy("cls").agg(F.min("pos").alias("first"))
        there = first.unionByName(first.join(near, first["cls"] == near["a"]).select(F.col("b").alias("cls"), "first"))
        reach = there.groupBy("cls").agg(F.min("first").alias("reach"))
        blocked = left.join(reach, "cls").where("reach < pos").select("pos").distinct()
        free = settle(left.join(blocked, "pos", "left_anti"), "kept")
        kept = free.select("cls").distinct()
        left = left.join(free.select("pos").distinct(), "pos", "left_anti")


def _in_order(left: DataFrame, near: DataFrame) -> DataFrame:
    """greedy_rejects in one task, for a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered: set[str] = set()
        held: list[tuple[str, list[str]]] = []
        at, bad, out = None, False, []

        def close() -> None:
            if bad:
                out.append(at)
            else:
                for cls, others in held:
                    covered.update([cls, *others])

        for batch in batches:
            for pos, cls, others in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if pos != at:
                    if at is not None:
                        close()
                    at, bad, held = pos, False, []
                bad = bad or cls in covered
                held.append((cls, others))
        if at is not None:
            close()
        yield pa.record_batch([pa.array(out, pa.int64())], ["pos"])

    others = near.groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias("others"))
    rows = left.join(others, "cls", "left").select(F.col("pos").cast("long").alias("pos"), "cls", F.coalesce("others", F.array().cast("array<string>")).alias("others"))
    return rows.repartition(1).sortWithinPartitions("pos").mapInArrow(run, "pos long")


#: Classes of lists with more than LONG are looked at by lists' first rows, in so many rounds at most.
LONG, ROUNDS = 512, 6


def near_duplicates(sets: DataFrame, threshold: float = 0.82) -> DataFrame:
    """sets (id, grp, sh) -> (id, kept): in order of id a row is kept unless similar to a kept row of its group. Copies
    of a class share its fate, but for its first row. sh is as in similar_sets; a row whose group is null is similar to
    none but its copies.

    A class that comes first in each list of candidates that it is in is kept, and is compared with what is in those; what
    it is similar to goes. That is done for the classes of long lists, so that a large group of near copies makes no pairs
    of its own. What is left is paired as in similar_sets and goes through greedy_rejects.
    """
    percent = _whole_percent(threshold)
    with modest_batches(sets.sparkSession):
        slim, live, names, linked = _classed(sets, percent)
        similar = lambda pairs: linked(pairs).where(F.col("o") >= (F.col("na") + F.col("nb") - F.col("o")) * threshold - 1e-9)
        order = names.where("grp is not null").select("cls", F.col("id").cast("long").alias("at"))
        gone, left = _Parts(), live
        if not live.where(F.col("c") > LONG).isEmpty():
            kept = _first_in_lists(live, order, similar, gone, percent)
            left = live.join(kept.unionByName(gone.all()), "cls", "left_anti")
        links = similar(set_join.candidates(left, percent)).select("a", "b").join(order.select(F.col("cls").alias("a"), F.col("at").alias("at_a")), "a").join(order.select(F.col("cls").alias("b"), F.col("at").alias("at_b")), "b")
        links = settle(links.select(F.col("at_a").cast("string").alias("a"), F.col("at_b").cast("string").alias("b")), "links")
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    members = ends.select(F.col("a").cast("long").alias("pos"), F.col("a").alias("cls"), F.lit(False).alias("before"))
    gone.add(greedy_rejects(members, links).join(order.select("cls", F.col("at").alias("pos")), "pos").select("cls"))
    out = slim.select("id", "cls").join(names.select("cls", F.col("id").alias("first")), "cls", "left").join(gone.all().withColumn("gone", F.lit(True)), "cls", "left")
    return out.select("id", F.when(F.col("cls").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("first"), F.lit(False)) & F.col("gone").isNull()).alias("kept"))


def _first_in_lists(live: DataFrame, order: DataFrame, similar: Callable[[DataFrame], DataFrame], gone: _Parts, percent: int) -> DataFrame:
    """near_duplicates' rounds over the classes of long lists and over what shares a list with one: the classes (cls) kept;
    those rejected are added to gone. All lists of such a class are looked at, so only such classes can be found first."""
    hot = settle(live.where(F.col("c") > LONG).select("cls").distinct(), "hot")
    lists = live.join(hot, "cls", "left_semi").select("h").distinct()
    left = settle(live.join(lists, "h", "left_semi").join(order, "cls").join(hot.withColumn("hot", F.lit(True)), "cls", "left"), "region")
    kept = _Parts()
    for _ in range(ROUNDS):
        firsts = left.groupBy("h", "c").agg(F.min("at").alias("first"))
        there = set_join.on_a_salt(left.where("hot"), "cls").join(set_join.on_every_salt(firsts), ["h", "salt"])
        free = settle(there.groupBy("cls").agg(F.max(F.col("at") > F.col("first")).alias("later")).where("not later").select("cls"), "kept")
        kept.add(free)
        heads = set_join.on_every_salt(left.join(free, "cls", "left_semi").select("h", "c", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa")))
        rest = left.join(free, "cls", "left_anti")
        pairs = set_join.on_a_salt(rest, "cls").join(heads, ["h", "salt"]).where(set_join.may_begin("na", "n", "pa", "pos", percent)).select("a", F.col("cls").alias("b")).distinct()
        hit = settle(similar(pairs).select(F.col("b").alias("cls")).distinct(), "rejected")
        gone.add(hit)
        before, left = left, settle(rest.join(hit, "cls", "left_anti"), "region")
        drop_settled(before)
        if left.where(F.col("c") > LONG).groupBy("h").count().where(F.col("count") > LONG).isEmpty():
            break
    return kept.all()

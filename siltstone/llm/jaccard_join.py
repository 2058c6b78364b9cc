"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order of n-grams is (how common, 64-bit hash), common ones last. Two sets that are similar enough share an
n-gram of their first n - ceil(t * n) + 1 in this order, so only those make candidates, and only where the places of the
n-gram leave enough to share. For candidates the order is cut into fragments, the sets' parts in each fragment are
intersected apart, and the partial counts are summed by pair.

Texts with one and the same set are one class and are never paired. Lists of an n-gram with few classes are paired as
they are. Each longer list has a hub, a class that is in many lists; each class goes with the hub of most of its lists,
and where two hubs are near, their parts become one (_parted, _merged). Sets are then differences from their hub's:
D = x ^ B. Within a part |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, so the pairs that need nothing of Dx & Dy are known from
sizes alone, and a link to the class nearest to B stands for all of them; the others share an element of D, and D is small
where sets are near copies (_within_groups). For pairs of two parts |x ^ y| >= |B1 ^ B2| - |Dx| - |Dy|: members of like
distance from their hubs are compared as one, and only those that can come near enough are paired (_between_parts). So the
work follows the number of classes, not its square, and no pair that could join two components is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import drop_settled, modest_batches, settle
from siltstone.llm.components import connected_components
from siltstone.operators.set_join import Rule, candidates, fetched, may_begin, on_a_salt, on_every_salt, overlaps, prepared

#: Classes in a list that are paired directly; longer lists make groups. The same within a group.
FEW, FEW_WITHIN = 16, 256
#: Turns in which a class looks for a hub before it is its own.
HUBS = 3
#: A hot group's rows are spread over so many keys where they meet the group's own row.
SALTS = 32


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar enough."""
    return settle(overlaps(pairs, segments, percent).select("a", "b"), "links")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.col("text").cast("string"))


def _grouped(lists: DataFrame) -> DataFrame:
    """lists (key, cls) -> (grp, cls) distinct: lists that a class links are one group."""
    first = lists.groupBy("cls").agg(F.min("key").alias("first"))
    roots = connected_components(lists.join(first, "cls").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")).distinct())
    named = lists.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return named.select(F.coalesce("root", "key").alias("grp"), "cls").distinct()


def _by_group(left: DataFrame, right: DataFrame, salt: str = "cls") -> DataFrame:
    """left join right by grp; right has a row a group, or none. A hot group's rows are spread by a salt."""
    every = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(every, ["grp", "salt"], "left").drop("salt")


def _apart(items: DataFrame, less: int = 2) -> DataFrame:
    """items (grp, cls, n, s) with d, s's difference from what most of the group have, and whether that is of use: where
    it does not make the sets `less` times smaller in all (few or no elements are in most of them), d is s and stuck is
    true."""
    counts = items.select("grp", F.explode("s").alias("e")).groupBy("grp", "e").agg(F.count(F.lit(1)).alias("c"))
    sizes = items.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("s")).alias("all"))
    # What the differences have in all, from counts alone.
    split = F.col("c") * 2 > F.col("size")
    known = settle(_by_group(counts, sizes, "e").withColumn("most", split), "counts")
    total = known.groupBy("grp", "all").agg(F.sum(F.when(F.col("most"), F.col("size") - F.col("c")).otherwise(F.col("c"))).alias("rest"))
    base = _by_group(known.where("most").select("grp", "e"), total.where(F.lit(less) * F.col("rest") <= F.col("all")).select("grp", F.lit(True).alias("use")), "e").where("use").groupBy("grp").agg(F.collect_list("e").alias("b"))
    moved = F.when(F.col("b").isNull(), F.col("s")).otherwise(F.concat(F.array_except("s", "b"), F.array_except("b", "s")))
    out = settle(_by_group(items, base).select("grp", "cls", "n", moved.alias("d"), F.col("b").isNull().alias("stuck")), "apart")
    drop_settled(known)
    return out


def _differences(items: DataFrame, homes: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, cls, n, d): the difference d of each class (cls, n, s) of homes (cls, grp) from the set of the class grp."""
    hubs = sets.select(F.col("cls").alias("grp"), F.col("s").alias("b"))
    named = items.join(homes, "cls")
    every = hubs.join(homes.select("grp").distinct(), "grp", "left_semi")
    both = _by_group(named, every)
    return both.select("grp", "cls", "n", F.concat(F.array_except("s", "b"), F.array_except("b", "s")).alias("d"))


def _parted(live: DataFrame, items: DataFrame) -> DataFrame:
    """live (h, c, cls, ...) of long lists, items (cls, n, s) of their classes -> (grp, cls, n, d): each class with a hub,
    grp, and what it differs by. A list's hub is the class that is in most lists; a class goes with the hub of most of its
    lists. Those that differ by more than half try others, and after HUBS turns are hubs of their own."""
    lists, sets, done = settle(live.select("h", "c", "cls"), "lists"), items, []
    for turn in range(HUBS):
        often = lists.groupBy("cls").agg(F.count(F.lit(1)).alias("lists"))
        best = F.max(F.struct("lists", F.xxhash64(F.lit(turn), "cls"), "cls")).getField("cls")
        hubs = on_every_salt(lists.join(often, "cls").groupBy("h", "c").agg(best.alias("grp")))
        votes = on_a_salt(lists, "cls").join(hubs, ["h", "salt"]).groupBy("cls", "grp").agg(F.count(F.lit(1)).alias("v"))
        homes = settle(votes.groupBy("cls").agg(F.max(F.struct("v", F.col("cls") == F.col("grp"), "grp")).getField("grp").alias("grp")), "homes")
        # A hub stays with itself where others come to it.
        chosen = homes.select("grp").distinct().select(F.col("grp").alias("cls"), F.col("grp").alias("own"))
        homes = homes.join(chosen, "cls", "left").select("cls", F.coalesce("own", "grp").alias("grp"))
        apart = settle(_differences(items, homes, sets).withColumn("near", 2 * F.size("d") <= F.col("n")), "apart")
        done.append(apart.where("near").drop("near"))
        rest = apart.where("not near").select("cls")
        if rest.isEmpty():
            break
        items = items.join(rest, "cls", "left_semi")
        lists = settle(lists.join(rest, "cls", "left_semi"), "lists")
    else:
        done.append(items.select(F.col("cls").alias("grp"), "cls", "n", F.array().cast("array<long>").alias("d")))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return settle(every, "parts")


def _merged(live: DataFrame, items: DataFrame, parts: DataFrame, bases: DataFrame) -> DataFrame:
    """parts, where parts that meet in a list and whose hubs differ by half their sets at most are one: each goes to the
    largest such part that is larger than itself, if that stays."""
    homes = settle(live.select("h", "cls").join(parts.select("cls", "grp"), "cls").select("h", "grp").distinct(), "homes")
    counted = homes.join(homes.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "h")
    met = on_a_salt(counted.withColumnRenamed("grp", "grp1"), "grp1").join(on_every_salt(counted.withColumnRenamed("grp", "grp2")), ["h", "salt"])
    far = _far(met.where("grp1 < grp2").select("grp1", "grp2").distinct(), bases)
    near = settle(far.where(4 * F.col("far") <= F.col("both")).select("grp1", "grp2"), "near")
    sizes = parts.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    ways = near.unionByName(near.select(F.col("grp2").alias("grp1"), F.col("grp1").alias("grp2")))
    best = ways.join(sizes.withColumnRenamed("grp", "grp2"), "grp2").groupBy(F.col("grp1").alias("grp")).agg(F.max(F.struct("size", F.col("grp2").alias("to"))).alias("best"))
    moves = settle(best.join(sizes, "grp").where("best > named_struct('size', size, 'to', grp)").select("grp", F.col("best.to").alias("to")), "moves")
    moves = moves.join(moves.select(F.col("grp").alias("to")), "to", "left_anti")
    moved = settle(parts.select("cls", "grp").join(moves, "grp").select("cls", F.col("to").alias("grp")), "moved")
    drop_settled(homes, near)
    again = _differences(items, moved, items)
    return settle(parts.join(moved.select("cls"), "cls", "left_anti").unionByName(again), "parts")


def _bases(items: DataFrame, parts: DataFrame) -> DataFrame:
    """(grp, b): the hubs' sets."""
    return items.join(parts.select(F.col("grp").alias("cls")).distinct(), "cls", "left_semi").select(F.col("cls").alias("grp"), F.col("s").alias("b"))


def _far(pairs: DataFrame, bases: DataFrame) -> DataFrame:
    """pairs (grp1, grp2) with far = |B1 ^ B2| and both = |B1| + |B2|."""
    named = [bases.select(F.col("grp").alias(f"grp{k}"), F.col("b").alias(f"b{k}")) for k in "12"]
    both = (F.size("b1") + F.size("b2")).cast("long")
    return pairs.join(named[0], "grp1").join(named[1], "grp2").select("grp1", "grp2", (both - 2 * F.size(F.array_intersect("b1", "b2"))).alias("far"), both.alias("both"))


def _between_parts(live: DataFrame, parts: DataFrame, bases: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes of two parts that meet in a list of live (h, c, cls, n, pos) and can be near enough.

    q |x ^ y| <= (100 - percent) (|x| + |y|) with q = 100 + percent is a link, so v(x) + v(y) >= q |B1 ^ B2| with v(x) =
    q |Dx| + (100 - percent) |x| must hold. Members of a part in a list are cells by their distance from B; cells are
    compared first, by the most that any of theirs has, and only members of cells that pass are paired.
    """
    q, slack = 100 + percent, 100 - percent
    own = parts.select("cls", "grp", F.size("d").cast("long").alias("nd"))
    rows = live.join(own, "cls").withColumn("v", F.lit(q) * F.col("nd") + F.lit(slack) * F.col("n"))
    rows = settle(rows.withColumn("cell", F.floor(F.log2(F.lit(1) + F.lit(64) * F.col("nd") / F.col("n"))).cast("int")), "members")
    cells = rows.groupBy("h", "grp", "cell").agg(F.max("v").alias("v"), F.max(F.col("n") - F.col("pos")).alias("left"), F.min("n").alias("least"), F.max("n").alias("most"))
    cells = settle(cells, "cells")
    counted = cells.join(cells.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "h")
    x, y = (counted.select("h", "c", *[F.col(c).alias(f"{c}{k}") for c in ("grp", "cell", "v", "left", "least", "most")]) for k in "12")
    met = on_a_salt(x, "grp1").join(on_every_salt(y), ["h", "salt"]).where("grp1 < grp2")
    met = met.where(F.lit(q) * F.least("left1", "left2") >= F.lit(percent) * (F.col("least1") + F.col("least2")))
    met = met.where((100 * F.col("most1") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least1")))
    met = settle(met.select("h", "grp1", "cell1", "v1", "grp2", "cell2", "v2"), "cells_met")
    far = _far(met.select("grp1", "grp2").distinct(), bases)
    far = settle(far.select("grp1", "grp2", (F.lit(q) * F.col("far")).alias("far")), "far")
    able = met.join(far, ["grp1", "grp2"]).where("v1 + v2 >= far").select("h", "grp1", "cell1", "grp2", "cell2", "far")
    x, y = (rows.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("grp", "cell", "cls", "n", "pos", "v")]) for k in "12")
    pairs = able.join(x, ["h", "grp1", "cell1"]).join(y, ["h", "grp2", "cell2"]).where("v1 + v2 >= far").where(may_begin("n1", "n2", "pos1", "pos2", percent))
    out = settle(pairs.select(F.least("cls1", "cls2").alias("a"), F.greatest("cls1", "cls2").alias("b")).distinct(), "pairs")
    drop_settled(rows, cells, met, far)
    return out


def _within_groups(items: DataFrame, percent: int) -> list[DataFrame]:
    """items (grp, cls, n, d: difference from a base, stuck: there is none, and d is the set) -> links (a, b) that join, in
    each group, all that its pairs' links join.

    With q = 100 + percent and f(x) = q |Dx| - (100 - percent) |x|, x and y link iff f(x) + f(y) <= 2 q |Dx & Dy|. m has
    the least f; x is near if f(x) + f(m) <= 0. Near ones link with m, whatever they share, so pairs of two near ones add
    nothing. A pair with a far one shares (f(x) + f(y)) / 2q elements of D or more, at least one; it is found by prefixes
    of D in the order of their counts within the group. Lists of more than FEW_WITHIN make groups again, one level down
    with D for the sets, until there is no base.
    """
    q, found = 100 + percent, []
    while True:
        apart = items.withColumn("nd", F.size("d").cast("long"))
        apart = settle(apart.withColumn("f", F.lit(q) * F.col("nd") - F.lit(100 - percent) * F.col("n")), "apart")
        hubs = settle(apart.groupBy("grp").agg(F.min(F.struct("f", "cls")).alias("m")).select("grp", F.col("m.f").alias("fm"), F.col("m.cls").alias("m")), "hubs")
        near = settle(_by_group(apart.drop("d", "n"), hubs).withColumn("far", F.col("f") + F.col("fm") > 0), "near")
        found.append(settle(near.where("not far and cls <> m").select(F.least("cls", "m").alias("a"), F.greatest("cls", "m").alias("b")), "stars"))

        least = near.where("far").groupBy("grp").agg(F.min("f").alias("ff"))
        bound = _by_group(near, least).where("ff is not null").withColumn("o", F.greatest(F.lit(1), F.ceil((F.col("f") + F.when(F.col("far"), F.col("fm")).otherwise(F.col("ff"))) / F.lit(2 * q))))
        bound = bound.withColumn("upto", F.col("nd") - F.col("o") + 1).where("upto > 0").select("grp", "cls", "nd", "f", "far", "stuck", "upto")
        whole = bound.join(apart.select("grp", "cls", "d"), ["grp", "cls"])
        flat = settle(whole.select("grp", "cls", "nd", "f", "far", "stuck", "upto", F.explode("d").alias("e")), "flat")
        often = flat.groupBy("grp", "e").agg(F.count(F.lit(1)).alias("df"), F.max("far").alias("some")).where("df > 1 and some").select("grp", "e", "df")
        own = Window.partitionBy("grp", "cls")
        # What no other set has, or only near ones, comes first.
        placed = flat.join(often, ["grp", "e"]).withColumns({"r": F.row_number().over(own.orderBy("df", "e")), "shared": F.count(F.lit(1)).over(own)})
        placed = placed.withColumn("pos", F.col("nd") - F.col("shared") + F.col("r") - 1).where("pos < upto").select("grp", "e", "cls", "nd", "f", "far", "stuck", "pos")
        placed = settle(placed, "placed")
        lists = placed.groupBy("grp", "e").agg(F.count(F.lit(1)).alias("c"), F.max("far").alias("some")).where("c > 1 and some").select("grp", "e", "c")
        placed = settle(placed.join(lists, ["grp", "e"]), "placed")
        drop_settled(flat, near, hubs)

        few = placed.where(F.col("stuck") | (F.col("c") <= FEW_WITHIN))
        left = few.select("grp", "e", F.col("cls").alias("a"), F.col("nd").alias("na"), F.col("f").alias("fa"), F.col("far").alias("ra"), F.col("pos").alias("pa"))
        right = few.select("grp", "e", F.col("cls").alias("b"), F.col("nd").alias("nb"), F.col("f").alias("fb"), F.col("far").alias("rb"), F.col("pos").alias("pb"))
        enough = F.lit(2 * q) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.col("fa") + F.col("fb")
        pairs = left.join(right, ["grp", "e"]).where("a < b and (ra or rb)").where(enough).select("grp", "a", "b", "fa", "fb").distinct()
        both = pairs.join(apart.select("grp", F.col("cls").alias("a"), F.col("d").alias("da")), ["grp", "a"]).join(apart.select("grp", F.col("cls").alias("b"), F.col("d").alias("db")), ["grp", "b"])
        found.append(settle(both.where(F.lit(2 * q) * F.size(F.array_intersect("da", "db")) >= F.col("fa") + F.col("fb")).select("a", "b"), "links"))

        many = placed.where(~F.col("stuck") & (F.col("c") > FEW_WITHIN)).select(F.xxhash64("grp", "e").alias("key"), "cls", "grp")
        if many.isEmpty():
            drop_settled(apart, placed)
            return found
        again = _grouped(many.select("key", "cls")).withColumnRenamed("grp", "sub")
        parent = many.select("cls", "grp").distinct()
        below = again.join(parent, "cls").join(apart.select("grp", "cls", "n", "d"), ["grp", "cls"])
        items = _apart(settle(below.select(F.xxhash64("grp", "sub").alias("grp"), "cls", "n", F.col("d").alias("s")), "items"))
        drop_settled(apart, placed)


def similar_pairs(docs: DataFrame, k: int = 5, percent: int = 80, common_from: int = 4, fragments: int = 8) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_shingles, cls, n_links) of each row of docs, (a, b) of each linked pair of classes, a < b).

    The join itself: every pair of different sets that links as in similar_classes is verified, within components too.
    Equal sets are one class; n_links counts the other rows that a row links with, its class's own among them. A row
    with the empty set has no class and no links. A group of n sets that all link has n * (n - 1) / 2 pairs.
    """
    with modest_batches(docs.sparkSession):
        return _similar_pairs(docs, k, percent, common_from, fragments)


def _similar_pairs(docs: DataFrame, k: int, percent: int, common_from: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    docs, common, slim, live = prepared(_texts(docs), Rule(k), percent, common_from)
    pairs = settle(candidates(live, percent), "pairs")
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    segments = fetched(ends, docs, Rule(k), common, fragments)
    links = _verified(pairs, segments, percent)
    drop_settled(live, pairs, segments)
    sizes = slim.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("c"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("c").alias("others"))
    counts = sizes.join(others, "cls", "left").select("cls", (F.col("c") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = slim.join(counts, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows, links


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 80, common_from: int = 4, fragments: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, cls, root, component_id, *keep), one row for each row of docs.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of k-word runs (words between ASCII
    white space, A-Z lower-cased; of fewer words the whole text is the one run). root is a key of what links reach, the
    same for all of a component; component_id is the smallest doc_id there. A null or empty text has the empty set, links
    with nothing, keeps its own doc_id and has null for cls and root. Repeated rows link like other equal texts. A null
    doc_id is never a component_id unless all of the component's are null. Columns that are not in keep are ignored,
    whatever their names; keep may not name one of the result's own or `n`, `prefix`, `text`. An empty table gives an
    empty result. Texts are read three times, whole, and nothing of all texts is gathered: what is broadcast are bitmaps
    of bounded size. Sets and n-grams are told apart by 64-bit hashes (n-grams by 62 bits where they are paired).
    """
    with modest_batches(docs.sparkSession):
        return _similar_classes(docs, k, percent, common_from, fragments, keep)


def _similar_classes(docs: DataFrame, k: int, percent: int, common_from: int, fragments: int, keep: tuple[str, ...]) -> DataFrame:
    docs, common, slim, live = prepared(_texts(docs), Rule(k), percent, common_from, keep)
    pairs = settle(candidates(live.where(F.col("c") <= FEW), percent), "pairs")
    long = live.where(F.col("c") > FEW)
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(long.select("cls"))
    segments = fetched(ends, docs, Rule(k), common, fragments)
    links = [_verified(pairs, segments, percent)]
    if not long.isEmpty():
        whole = segments.join(long.select("cls").distinct(), "cls", "left_semi").groupBy("cls", "n").agg(F.flatten(F.collect_list("seg")).alias("s"))
        items = settle(whole, "items")
        parts = _parted(long, items)
        parts = _merged(long, items, parts, _bases(items, parts))
        between = _between_parts(long, parts, _bases(items, parts), percent)
        links.append(_verified(between.join(pairs, ["a", "b"], "left_anti"), segments, percent))
        # What most of a part differ from their hub by is the hub's own: without it they differ by less.
        centred = _apart(parts.select("grp", "cls", "n", F.col("d").alias("s")), less=1)
        links += _within_groups(centred.withColumn("stuck", F.lit(False)), percent)
        drop_settled(items, parts, between, centred)
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    roots = settle(connected_components(every), "roots")
    drop_settled(live, pairs, segments, *links)

    classes = slim.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = settle(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.select("cls", "root").join(least, "root")
    out = slim.drop("prefix").join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "cls", "root", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), *[F.col(f"`{c}`") for c in keep])

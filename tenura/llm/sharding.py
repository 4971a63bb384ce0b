"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards, sizes stay even.

Documents are linked where they agree in a link column. Those that agree in all of them are interchangeable, so what
moves is a number of copies: the state has a row for each such unit and shard, whatever the number of documents. Linked
copies are dealt evenly at first. In each round every unit adds up, by joins with its links, how many neighbours it has
in each shard, and looks for the shard where most of them can be together; copies elsewhere want to go there. Shards
swap copies, in pairs or rings, and take more while they have room; what gains most goes first. So no shard is ever over
its quota, and with quotas at most one apart the counts are, too. Rounds end when nothing can move. Documents without
links then fill what room is left.

Numbers within large sets (the places of copies in a unit, of documents in a shard) come from counts by hash bucket and
a window within each bucket, so that no task holds a whole unit or shard. Only DataFrame functions are used, and what
comes to the driver are the moves wanted between shards, shards^2 numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, scratch, table, written

SHARDS, ROUNDS, BUCKETS = 16, 8, 1024


def rows_before(rows: DataFrame, name: str, by: list[str], key: list[str], value: Column | None = None, lead: list[str] | None = None) -> DataFrame:
    """`rows` with `name`: the sum of `value` (1) over the rows of the same `by` that come before by `lead`, then in a fixed order by `key`.

    Sums of (by, lead, hash bucket) and their running sums are few enough to be broadcast: `by` and `lead` have a bounded
    number of values, times BUCKETS. Within a bucket a window adds up row by row.
    """
    value = F.lit(1) if value is None else value
    place = [*by, *(lead or []), "_bucket"]
    rows = rows.withColumns({"_value": value.cast("long"), "_bucket": F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")})
    sums = rows.groupBy(*place).agg(F.sum("_value").alias("_sum"))
    running = Window.partitionBy(*by).orderBy(*(lead or []), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(*place, F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_begin"))
    within = Window.partitionBy(*place).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return out.join(F.broadcast(begins), place).withColumn(name, F.col("_begin") + F.col("_within")).drop("_value", "_bucket", "_begin", "_within")


def slot_of(upto: list[int], number: Column) -> Column:
    """The first i with number < upto[i], of few ascending bounds."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(upto))):
        out = F.when(number < upto[i], i).otherwise(out)
    return out


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def allowed(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Copies that may go from one shard to another: what comes into a shard may exceed what leaves it by its room.

    Wishes go round in cycles, the shortest first: swaps, longer rings, and ways that end in a shard with room.
    """
    free = len(room)  # a place that takes what a shard has room for, and gives without end
    left = {pair: n for pair, n in wanted.items() if n > 0} | {(j, free): r for j, r in enumerate(room) if r > 0} | {(free, i): 1 << 62 for i in range(free)}

    def ring() -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []
        for start in range(free):
            came, line = {}, [start]
            for x in line:
                for y in range(free + (x != start or len(line) > 1)):  # the first step is a wish
                    if left.get((x, y)) and y not in came:
                        came[y] = x
                        line.append(y)
                if start in came:
                    way, at = [], start
                    while not way or at != start:
                        way.append((came[at], at))
                        at = came[at]
                    best = way if not best or len(way) < len(best) else best
                    break
        return best

    while way := ring():
        n = min(left[e] for e in way)
        for e in way:
            left[e] -= n
    return {pair: n - left.get(pair, 0) for pair, n in wanted.items()}


def dealt_cells(units: DataFrame, shards: int) -> DataFrame:
    """(unit, shard, n): the copies of all `units` (unit, n) dealt one by one, shard after shard."""
    placed = rows_before(units, "at", [], ["unit"], F.col("n")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    upto = lambda end: F.floor((end - F.col("shard") + shards - 1) / shards)
    return placed.select("unit", "shard", (upto(F.col("at") + F.col("n")) - upto(F.col("at"))).cast("long").alias("n")).where("n > 0")


def moves(cells: DataFrame, links: DataFrame, room: list[int], quota: int, round_no: int) -> DataFrame:
    """(unit, source, target, n, level): the copies of `cells` that want to go elsewhere; a lower level gains more.

    The shard that a unit wants is the one that could hold most of its neighbours and itself, given the room there. A
    group larger than a shard wants as many shards as it needs, filled one after the other. A unit all of whose neighbours are where it is stays.
    """
    shards = len(room)
    spread = lambda n: F.array(*(F.coalesce(F.sum(F.when(F.col("shard") == s, n)), F.lit(0)) for s in range(shards)))
    own = cells.groupBy("unit").agg(spread(F.col("n")).alias("own"), F.sum("n").alias("total"), F.count("*").alias("places"))
    seen = cells.join(links, "unit").groupBy("link").agg(spread(F.col("n")).alias("seen"), F.sum("n").alias("size"))
    pull = F.array(*(F.sum(F.get("seen", F.lit(s))) for s in range(shards)))
    near = links.join(seen, "link").groupBy("unit").agg(pull.alias("pull"), F.max("size").alias("size"), F.count("*").alias("kinds"))
    rooms = F.array(*(F.lit(r).cast("long") for r in room))
    at = lambda c, s: F.get(F.col(c), s)
    # neighbours and copies that could be together in shard s
    value = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: at("pull", s) + F.col("kinds") * F.least(F.col("total") - at("own", s), F.get(rooms, s)))
    both = own.join(near, "unit").withColumn("value", value).withColumn("needs", F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(max(quota, 1)))).cast("int"))
    away = F.exists(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (at("own", s) == 0) & (at("pull", s) > 0))
    both = both.where(away | (F.col("places") > F.col("needs")) | (F.col("needs") > 1))
    # a large group that has no shard too many still fills its foremost shards from the last one
    wanted = F.least(F.when(F.col("places") > F.col("needs"), F.col("needs")).otherwise(F.greatest(F.lit(1), F.col("needs") - 1)), F.lit(shards))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct((-at("value", s)).alias("v"), (-at("pull", s)).alias("p"), F.xxhash64("unit", s, F.lit(round_no)).alias("h"), s.alias("s"))))
    wants = both.select("unit", "own", "total", "value", F.transform(F.slice(ranked, F.lit(1), wanted), lambda r: r["s"]).alias("to"))
    # wanted shards are filled one after the other: `ends` has how many copies it takes until each is full
    fits = lambda s: F.least(F.get(rooms, s), F.col("total") - at("own", s))
    ends = F.transform("to", lambda t, i: F.aggregate(F.slice("to", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, s: a + fits(s)))
    leaving = F.filter(F.transform("own", lambda n, s: F.struct(s.alias("source"), n.alias("n"))), lambda c: (c["n"] > 0) & ~F.array_contains("to", c["source"]))
    leaving = F.transform(leaving, lambda c, i: F.struct(c.alias("c"), F.aggregate(F.slice(leaving, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("ahead")))
    out = wants.withColumn("ends", ends).select("unit", "value", "to", "ends", F.explode(leaving).alias("c")).select("unit", "value", "to", "ends", "c.c.*", "c.ahead")
    nth = F.size(F.filter("ends", lambda e: e <= F.col("ahead")))
    out = out.withColumn("target", F.get("to", F.when(nth < F.size("to"), nth).otherwise(0)))
    gain = F.get("value", F.col("target")) - F.get("value", F.col("source"))
    return out.withColumn("gain", gain).where("gain >= 0").select("unit", "source", "target", "n", (-F.floor(F.log2(F.col("gain") + 1))).cast("int").alias("level"))


def propagated(cells: DataFrame, links: DataFrame, room: list[int], quota: int, rounds: int) -> tuple[DataFrame, list[int]]:
    """(cells, room) after at most `rounds` rounds, or when nothing more can move."""
    spark, shards, room = cells.sparkSession, len(room), list(room)
    for r in range(rounds):
        wish = written(moves(cells, links, room, quota, r), "moves")
        wanted = {(x["source"], x["target"]): x["n"] for x in wish.groupBy("source", "target").agg(F.sum("n").alias("n")).collect()}  # shards^2 at most
        may = {pair: n for pair, n in allowed(wanted, room).items() if n}
        if not may:
            break
        most = F.array(*(F.lit(may.get((i, j), 0)).cast("long") for i in range(shards) for j in range(shards)))
        ahead = rows_before(wish, "ahead", ["source", "target"], ["unit"], F.col("n"), ["level"])
        moved = ahead.withColumn("n", F.least("n", F.get(most, F.col("source") * shards + F.col("target")) - F.col("ahead"))).where("n > 0")
        change = moved.select("unit", F.explode(F.array(F.struct(F.col("source").alias("shard"), (-F.col("n")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("n").alias("n")))).alias("c"))
        cells = written(cells.select("unit", "shard", "n").unionByName(change.select("unit", "c.shard", "c.n")).groupBy("unit", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
        for (i, j), n in may.items():
            room[i] += n
            room[j] -= n
    return cells, room


def sharded(docs: DataFrame, links: list[str], shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", name: str = "place") -> DataFrame:
    """`docs` with one more column `name`, a struct (shard int, slot long): counts of shards are at most one apart.

    Documents with the same value in a column of `links` are linked; null links nothing. A group that fits goes to one
    shard unless others took the room first, a larger one to as few shards as it needs. Slots number a shard's
    documents without a gap. Give narrow `docs`: all its columns travel. Rows may repeat, ids too, and ids may be null;
    rows alike in all columns are interchangeable. `name` must be new to `docs`, other columns may have any name, and any
    type but map. An empty table gives an empty result.
    """
    if fresh(docs, name) != name:
        raise ValueError(f"the documents have a column {name}")
    spark, columns = docs.sparkSession, docs.columns
    with scratch(spark, keep=True):
        row = F.struct(*(F.col(f"`{c}`") for c in columns))
        linked = F.filter(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.md5(F.concat(F.lit(f"{k}:"), F.col(f"`{c}`").cast("string")).cast("binary"))) for k, c in enumerate(links))), lambda x: x.isNotNull())
        base = docs.select(row.alias("row"), linked.alias("links"))
        alone = F.md5(F.to_json("row").cast("binary"))  # of rows without any link
        unit = F.when(F.size("links") == 0, F.concat(F.lit("-"), alone)).otherwise(F.array_join("links", ","))
        base = written(base.select("row", F.col(f"row.`{id_col}`").cast("string").alias("id"), F.xxhash64("row").alias("print"), unit.alias("unit"), "links"), "documents")
        n = base.count()
        quota = quotas(n, shards)
        units = base.groupBy("unit").agg(F.first("links").alias("links"), F.count("*").alias("n"))
        of = units.select("unit", "n", F.explode("links").alias("link"))
        shared = of.groupBy("link").agg(F.sum("n").alias("k")).where("k > 1").select("link")
        links_of = written(of.join(shared, "link").select("unit", "link", "n"), "links")
        cells = written(dealt_cells(links_of.groupBy("unit").agg(F.first("n").alias("n")), shards), "cells")
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        cells, room = propagated(cells, links_of.select("unit", "link"), [q - load.get(s, 0) for s, q in enumerate(quota)], min(quota), rounds)
        # a unit's copies in a fixed order, and where the piece of each shard ends
        pieces = F.array_sort(F.collect_list(F.struct("shard", "n")))
        ends = F.transform(pieces, lambda x, i: F.struct(x["shard"].alias("shard"), F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("upto")))
        cut = written(cells.groupBy("unit").agg(ends.alias("ends")), "pieces")
        key = ["id", "unit", "print"]
        base = base.withColumn("part", F.pmod(F.xxhash64("id", "print"), F.lit(BUCKETS)).cast("int"))
        counts = base.groupBy("unit", "part").agg(F.count("*").alias("k"))
        before = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        begins = counts.join(cut, "unit").select("unit", "part", "ends", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("begin"))
        numbered = base.withColumn("number", F.row_number().over(Window.partitionBy("unit", "part").orderBy(*key)) - 1).join(begins, ["unit", "part"], "left")
        own = F.get(F.filter("ends", lambda e: e["upto"] > F.col("begin") + F.col("number")), F.lit(0))["shard"]
        placed = written(numbered.select("row", "id", "unit", "print", own.cast("int").alias("shard")), "placed")
        fill = [sum(room[: s + 1]) for s in range(shards)]
        open_ = rows_before(placed, "at", [], key, F.when(F.col("shard").isNull(), 1).otherwise(0))
        filled = written(open_.withColumn("shard", F.coalesce("shard", slot_of(fill, F.col("at")))).drop("at"), "filled")
        out = rows_before(filled, "slot", ["shard"], key)
        return written(out.select("row.*", F.struct("shard", "slot").alias(name)), "sharded")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, those of equal texts together as far as shards of even counts allow."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length(text) + 1, F.lit(1)).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("none")).alias("print"))
    out = sharded(docs, ["print"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "place.shard", "place.slot", F.lit(None).cast("int").alias("grown_shard"))

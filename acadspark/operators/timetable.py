"""Timetable analytics: C5 clash pairs, E2 clash flags, C5b capacity clashes, C7 free slots,
E3 slot suggestions, D10 quality score, D11 weekly grid.

Times are seconds of day, intervals are half-open ``[start, end)`` so touching
slots (lunch ends 13:30, period 4 starts 13:30) do not clash.

Interval joins always carry an equi key. Besides (timetable, weekday,
resource) they are keyed by a *time bin*: one side is listed once per bin it
covers, the other once in the bin of its start, so each pair meets in exactly
one bin. A busy room or teacher is thereby split over many join keys (and
AQE's skew join can split further) instead of one task comparing every pair
of the day. Flags and counts need no pairs at all: they work on per-resource
time summaries whose size is bounded by the clock.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slot_text, weekday_name
from ..session import ensure_checkpoint_dir, stored

# Resource columns of each clash kind.
RESOURCES: dict[str, tuple[str, ...]] = {
    "room": ("room_id",),
    "faculty": ("faculty_id",),
    "section": ("course_id", "section"),
}
DEFAULT_BIN_SEC = 3600
#: a table of at most so many bytes (counted rows times a row's bytes) may be broadcast
SMALL_BYTES = 32 << 20
#: hash buckets over which the rows of the clash keys are counted; a bucket of more rows than this, and than twice the mean, is crowded
BUCKETS, CROWDED_ROWS = 1 << 16, 20_000
#: calm rows are dealt to so many times the session's shuffle partitions: they get longer and are sorted where they arrive
FINER = 4

# The standard university time slots (name, start, end, type), seconds of day.
STANDARD_SLOTS = (
    ("Period 1", 9 * 3600, 10 * 3600, "lecture"),
    ("Period 2", 10 * 3600 + 900, 11 * 3600 + 900, "lecture"),
    ("Period 3", 11 * 3600 + 1800, 12 * 3600 + 1800, "lecture"),
    ("Lunch Break", 12 * 3600 + 1800, 13 * 3600 + 1800, "lunch"),
    ("Period 4", 13 * 3600 + 1800, 14 * 3600 + 1800, "lecture"),
    ("Period 5", 14 * 3600 + 2700, 15 * 3600 + 2700, "lecture"),
    ("Period 6", 16 * 3600, 17 * 3600, "lecture"),
    ("Lab Session 1", 9 * 3600, 12 * 3600, "lab"),
    ("Lab Session 2", 13 * 3600 + 1800, 16 * 3600 + 1800, "lab"),
)
TEACHING_TYPES = ("lecture", "lab")


def _resource_text(cols: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in cols])


def _binned(e: DataFrame, bin_sec: int) -> DataFrame:
    first = F.floor(F.col("start_sec") / bin_sec)
    last = F.floor((F.col("end_sec") - 1) / bin_sec)
    return e.withColumn("_bin", F.explode(F.sequence(first, last)))


def resource_rows(entries: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per (entry, clash kind) with the kind's resource as text; NULL resources skipped."""
    structs = []
    for kind in kinds:
        res = list(RESOURCES[kind])
        ok = F.lit(True)
        for c in res:
            ok = ok & F.col(c).isNotNull()
        structs.append(F.when(ok, F.struct(F.lit(kind).alias("kind"), _resource_text(res).alias("resource"))))
    arr = F.filter(F.array(*structs), lambda x: x.isNotNull())
    # an interval that is empty, reversed or outside the day fails rule B8 and takes part in no clash; so every window
    # and bin range below is bounded by the clock
    return (entries.where(F.col("start_sec") < F.col("end_sec")).where("start_sec >= 0 and end_sec <= 86400")
            .select("entry_id", "timetable_id", "dow", "start_sec", "end_sec", F.explode(arr).alias("_r"))
            .select("_r.kind", "timetable_id", "dow", "_r.resource", "entry_id", "start_sec", "end_sec"))


_KEY = ["kind", "timetable_id", "dow", "resource"]


def split_crowded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The resource rows whose key is calm, and those whose key may hold very many rows.

    Rows are counted by a hash of their key, in at most ``BUCKETS`` groups with map-side combine; a crowded bucket sends
    all its keys to the second table. So each key is in one table as a whole, and a key of the first has at most
    ``CROWDED_ROWS`` rows or two means of a bucket: it may be sorted in one task. The list of crowded buckets is bounded
    and broadcast; while it is empty, AQE drops the second table unread.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*_KEY), F.lit(BUCKETS)).cast("int"))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    crowded = (sizes.withColumn("_mean", F.avg("_n").over(Window.partitionBy(F.lit(0))))   # BUCKETS rows at most
               .where(F.col("_n") > F.greatest(F.lit(CROWDED_ROWS), 2 * F.col("_mean"))).select("_bucket"))
    return tuple(rows.join(F.broadcast(crowded), "_bucket", how).drop("_bucket") for how in ("left_anti", "left_semi"))


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Calm rows dealt by their key in one exchange, to tasks of a fraction of a shuffle partition."""
    parts = FINER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*_KEY, *columns).repartition(parts, *_KEY)


def _by_key(rows: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """Calm rows dealt by their key, and the columns that their windows are partitioned by: first a hash of the key, so
    that most comparisons of the sort end at its first eight bytes."""
    return _dealt(rows, *columns).withColumn("_hash", F.xxhash64(*_KEY)), ["_hash", *_KEY]


def _clock_events(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Calm rows as ends (k = 0) and starts (k = 1), with the entries of the resource that are ``open`` just before."""
    r, key = _by_key(rows, "start_sec", "end_sec")
    events = F.array(F.struct(F.col("end_sec").alias("t"), F.lit(0).alias("k")), F.struct(F.col("start_sec").alias("t"), F.lit(1).alias("k")))
    h = r.select(*key, F.explode(events).alias("_ev")).select(*key, "_ev.t", "_ev.k")
    w = Window.partitionBy(*key).orderBy("t", "k")
    return h.withColumn("open", F.coalesce(F.sum(F.col("k") * 2 - 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), key


def clash_pairs(entries: DataFrame, kinds: Sequence[str] = ("room", "faculty", "section"),
                bin_sec: int = DEFAULT_BIN_SEC) -> DataFrame:
    """Overlapping entry pairs sharing a resource, ``entry_a < entry_b``.

    Output: kind, timetable_id, dow, resource, entry_a, entry_b. Of two
    overlapping entries, the one that starts later (ties: larger id) starts
    inside the other; an equi join with the residual "build starts within
    probe, after it" finds each pair exactly once. All kinds go through one join.

    Calm resources (``split_crowded``) are joined with themselves by (kind,
    timetable, dow, resource): both sides are the same rows, so Spark writes
    one exchange of a row per entry and kind and reads it twice. In crowded
    ones every entry is listed once per time bin it covers (the probe side) and
    once in the bin of its start (the build side), and the bin is part of the
    key: a busy resource is split over its bins, and AQE's skew join can split a
    hot bin further.
    """
    # no pair has a key with a NULL; said here, so that all branches read the entries in the same way
    r = resource_rows(entries.where(F.col("timetable_id").isNotNull() & F.col("dow").isNotNull()), kinds)
    calm, crowded = split_crowded(r)
    after = (F.col("b.start_sec") > F.col("a.start_sec")) | (
        (F.col("b.start_sec") == F.col("a.start_sec")) & (F.col("b.entry_id") > F.col("a.entry_id")))
    # the last holds by the others; with it the residual asks the same of both sides, which keeps them one exchange
    meet = [after, F.col("b.start_sec") < F.col("a.end_sec"), F.col("a.start_sec") < F.col("b.end_sec")]

    def pairs(probe: DataFrame, build: DataFrame, keys: Sequence[str]) -> DataFrame:
        cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + meet
        return probe.alias("a").join(build.alias("b"), cond, "inner").select(
            *[F.col(f"a.{k}").alias(k) for k in _KEY],
            F.least("a.entry_id", "b.entry_id").alias("entry_a"), F.greatest("a.entry_id", "b.entry_id").alias("entry_b"))
    binned = pairs(_binned(crowded, bin_sec), crowded.withColumn("_bin", F.floor(F.col("start_sec") / bin_sec)), [*_KEY, "_bin"])
    calm = _dealt(calm, "entry_id", "start_sec", "end_sec")
    return pairs(calm.hint("merge"), calm, _KEY).unionByName(binned)


def clash_flags(entries: DataFrame, kinds: Sequence[str] = ("room", "faculty", "section"),
                bin_sec: int = DEFAULT_BIN_SEC) -> DataFrame:
    """Entries that overlap at least one other entry on the same resource, without pairs.

    Ordered by start within the resource, an entry clashes iff one before it
    ends after it starts, or the next one starts before its end. Calm resources
    (``split_crowded``) are one exchange and one sweep window over their entries.

    In crowded ones there is one summary row per (kind, timetable, dow, resource,
    start time): how many entries start then and the latest end among them. The
    summary gives the largest end of all *earlier* starts and the next start. An
    entry clashes iff another entry starts at the same moment, or an earlier one
    ends after it starts, or the next start is before its end. These windows
    run over the summary -- at most one row per second of the day per resource,
    bounded by the clock -- and each entry meets its summary row by a many-to-one
    equi join, which AQE splits when a resource is hot. No window or sort ever
    holds a crowded resource's entries.
    ``bin_sec`` is accepted for interface compatibility and not needed.
    Output: kind, timetable_id, dow, resource, entry_id.
    """
    # keys with a NULL clash with nothing
    calm, r = split_crowded(resource_rows(entries.where(F.col("timetable_id").isNotNull() & F.col("dow").isNotNull()), kinds))
    calm, key = _by_key(calm, "entry_id", "start_sec", "end_sec")
    w = Window.partitionBy(*key).orderBy("start_sec")
    calm = (calm.withColumns({"_until": F.max("end_sec").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                              "_next": F.lead("start_sec").over(w)})
            .where((F.col("_until") > F.col("start_sec")) | (F.col("_next") < F.col("end_sec"))))
    w = Window.partitionBy(*_KEY).orderBy("start_sec")
    summary = (r.groupBy(*_KEY, "start_sec")
               .agg(F.count(F.lit(1)).alias("_n"), F.max("end_sec").alias("_max_end"))
               .select(*_KEY, "start_sec", "_n",
                       F.max("_max_end").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_end"),
                       F.lead("start_sec").over(w).alias("_next_start")))
    j = r.join(summary, [*_KEY, "start_sec"])
    hit = ((F.col("_n") > 1) | (F.col("_carry_end") > F.col("start_sec"))
           | (F.col("_next_start") < F.col("end_sec")))
    return calm.select(*_KEY, "entry_id").unionByName(j.where(F.coalesce(hit, F.lit(False))).select(*_KEY, "entry_id"))


def capacity_clashes(entries: DataFrame, rooms: DataFrame) -> DataFrame:
    """Entries whose class exceeds the room, and lab entries placed in non-lab rooms.

    An equi join to the room table.
    Output: entry_id, room_id, kind, need, capacity.
    """
    r = rooms.select("room_id", "capacity", F.col("type").alias("room_type"))
    j = entries.select("entry_id", "room_id", "max_students", "entry_type").join(r, "room_id")
    over = j.where(F.col("max_students") > F.col("capacity")).select(
        "entry_id", "room_id", F.lit("over_capacity").alias("kind"),
        F.col("max_students").alias("need"), "capacity")
    lab = j.where((F.col("entry_type") == "lab") & (F.col("room_type") != "lab")).select(
        "entry_id", "room_id", F.lit("lab_in_non_lab_room").alias("kind"),
        F.col("max_students").alias("need"), "capacity")
    return over.unionByName(lab)


Slots = Sequence[tuple] | DataFrame
_SLOT = "struct<slot_name:string,slot_start:int,slot_end:int,slot_type:string>"


def slot_list(slots: Slots = STANDARD_SLOTS, types: Sequence[str] = TEACHING_TYPES) -> list[tuple]:
    """The teaching slots (name, start, end, type), in order of start and name.

    ``slots`` is a tuple of them, or a ``time_slots`` table (slot_name, start_sec, end_sec, slot_type, and optionally
    is_active), of which the distinct active slots are read: a few rows, like a timetable's column heads.
    """
    if isinstance(slots, DataFrame):
        active = F.coalesce("is_active", F.lit(True)) if "is_active" in slots.columns else F.lit(True)
        rows = slots.where(active & (F.col("start_sec") < F.col("end_sec")))
        slots = [tuple(r) for r in rows.select("slot_name", "start_sec", "end_sec", "slot_type").distinct().collect()]
    return sorted((x for x in slots if x[3] in types), key=lambda x: (x[1], x[0]))


def teaching_slots(slots: Slots = STANDARD_SLOTS, types: Sequence[str] = TEACHING_TYPES) -> Column:
    """The teaching slots as one array of structs, in order of start and name."""
    cells = [F.struct(F.lit(n).alias("slot_name"), F.lit(s).cast("int").alias("slot_start"),
                      F.lit(e).cast("int").alias("slot_end"), F.lit(t).alias("slot_type"))
             for (n, s, e, t) in slot_list(slots, types)]
    return F.array(*cells) if cells else F.array().cast(f"array<{_SLOT}>")


def week_grid(slots: Slots = STANDARD_SLOTS, types: Sequence[str] = TEACHING_TYPES) -> Column:
    """The (weekday x teaching slot) grid as one array of structs."""
    one = teaching_slots(slots, types)
    return F.flatten(F.transform(F.array(*map(F.lit, range(1, 8))), lambda d: F.transform(one, lambda c: F.struct(
        d.alias("dow"), c["slot_name"].alias("slot_name"), c["slot_start"].alias("slot_start"),
        c["slot_end"].alias("slot_end"), c["slot_type"].alias("slot_type")))))


def busy_cells(entries: DataFrame, resource: str, slots: Slots = STANDARD_SLOTS) -> DataFrame:
    """(timetable, dow, resource, slot) cells that some entry overlaps, with the number of entries.

    Each entry is paired with the slots by a generator (at most the number of
    slots per entry) and kept where the intervals overlap; the count is a
    partial+final aggregate, so a busy room or teacher is reduced map-side and
    never compared pairwise.
    """
    return (entries.where(F.col("start_sec") < F.col("end_sec"))
            .select("timetable_id", "dow", resource, "start_sec", "end_sec", F.explode(teaching_slots(slots)).alias("c"))
            .where((F.col("c.slot_start") < F.col("end_sec")) & (F.col("start_sec") < F.col("c.slot_end")))
            .groupBy("timetable_id", "dow", resource, F.col("c.slot_name").alias("slot_name"))
            .agg(F.count(F.lit(1)).alias("n_busy")))


def every_room(entries: DataFrame, rooms: DataFrame, groups: int = 16) -> DataFrame:
    """(timetable_id, room_id): each timetable with every available room, the product that C7 asks for.

    Rooms are dealt to groups by a hash and timetables listed once per group, so the pairs come from an equi join
    whose tasks hold a part of the rooms each.
    """
    avail = rooms.where(F.col("is_available")).select(
        "room_id", F.pmod(F.xxhash64("room_id"), F.lit(groups)).cast("int").alias("_g"))
    tables = entries.select("timetable_id").distinct().select(
        "timetable_id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
    return tables.join(avail, "_g").drop("_g")


def free_slots(entries: DataFrame, rooms: DataFrame, slots: Slots = STANDARD_SLOTS) -> DataFrame:
    """For every timetable and available room, used by it or idle, the active
    teaching slots of the week that no entry in that room overlaps.

    The week grid is a generator (explode of an array, a bounded fan-out of 7 x
    slots per room), not a join; busy cells (``busy_cells``) are removed by a
    left-anti equi join on (timetable, dow, room, slot) -- no interval
    residual, so a crowded room costs linear work.
    Output: timetable_id, room_id, dow, slot_name, slot_start, slot_end, slot_type.
    """
    universe = (every_room(entries, rooms).select("timetable_id", "room_id", F.explode(week_grid(slots)).alias("c"))
                .select("timetable_id", "room_id", "c.*"))
    busy = busy_cells(entries, "room_id", slots)
    return universe.join(busy, ["timetable_id", "dow", "room_id", "slot_name"], "left_anti")


def slot_bits(cells: Sequence[tuple], test) -> Column:
    """A long with bit i set where ``test`` (a condition on slot i's start and end) holds."""
    bits = [F.when(test(F.lit(int(s)), F.lit(int(e))), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, (_, s, e, _) in enumerate(cells)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits, F.lit(0).cast("long"))


def busy_bits(entries: DataFrame, resource: str, slots: Slots = STANDARD_SLOTS) -> DataFrame:
    """Per (timetable, resource) the week as bitmaps: ``once`` and ``twice``, a long a weekday (Monday first), bit i set
    where at least one / two entries overlap the i-th teaching slot (in order of start and name).

    Counts a slot are sums with map-side combine, so a busy resource is a row a task; days are put together by
    ``bit_or``. Works for at most 62 teaching slots a day.
    """
    cells = slot_list(slots)
    counts = (entries.where(F.col("start_sec") < F.col("end_sec"))
              .groupBy("timetable_id", resource, "dow")
              .agg(*(F.count_if((F.lit(int(s)) < F.col("end_sec")) & (F.col("start_sec") < F.lit(int(e)))).alias(f"_{i}")
                     for i, (_, s, e, _) in enumerate(cells))))

    def at_least(n: int) -> Column:
        return reduce(lambda x, y: x.bitwiseOR(y),
                      [F.when(F.col(f"_{i}") >= n, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(len(cells))],
                      F.lit(0).cast("long"))

    def week(c: str) -> Column:
        zero = F.lit(0).cast("long")
        return F.array(*(F.bit_or(F.when(F.col("dow") == d, F.col(c)).otherwise(zero)) for d in range(1, 8)))
    return (counts.select("timetable_id", resource, "dow", at_least(1).alias("_once"), at_least(2).alias("_twice"))
            .groupBy("timetable_id", resource).agg(week("_once").alias("once"), week("_twice").alias("twice")))


def room_bits(free: DataFrame, rooms: DataFrame, k: int, slots: Slots = STANDARD_SLOTS) -> DataFrame:
    """Per (timetable, fit): ``fits``, for each weekday (capacity, bitmap) pairs by rising capacity, bit i set where a free
    room of at least that capacity is found in slot i; and ``best``, for each weekday and slot its k largest free rooms.

    ``fit`` is 'any' (all rooms) or 'lab' (lab rooms). The k largest are cut by a ranking that Spark limits before the
    shuffle, so a cell is k rows a task whatever the number of rooms. A row holds at most 7 x slots cells.
    """
    cells = slot_list(slots)
    n = len(cells)
    # fixed a day: the number of a slot by its name
    number = F.array_position(F.array(*(F.lit(x[0]) for x in cells)), F.col("slot_name")).cast("int") - 1
    rs = rooms.select("room_id", "capacity", F.col("type").alias("room_type"))
    kinds = F.when(F.col("room_type") == "lab", F.array(F.lit("any"), F.lit("lab"))).otherwise(F.array(F.lit("any")))
    w = Window.partitionBy("timetable_id", "dow", "slot_name", "fit").orderBy(F.col("capacity").desc(), "room_id")
    top = (free.join(rs, "room_id").select("timetable_id", "dow", "slot_name", "room_id", "capacity", F.explode(kinds).alias("fit"))
           .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
           .select("timetable_id", "fit", "dow", number.alias("slot"), "_r", "capacity", "room_id"))
    # in one pass: the best room of each capacity sets a bit, all rooms go to their cell
    first = F.when(F.col("_r") == 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot")))
    by_capacity = (top.groupBy("timetable_id", "fit", "dow", "capacity")
                   .agg(F.bit_or(first).alias("bits"),
                        F.collect_list(F.struct("slot", "_r", "capacity", "room_id")).alias("rooms")))
    week = by_capacity.groupBy("timetable_id", "fit").agg(
        F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("dow", "capacity", "bits"))).alias("_bits"),
        F.flatten(F.collect_list(F.transform("rooms", lambda r: F.struct(
            (F.col("dow") - 1).alias("day"), r["slot"].alias("slot"), r["_r"].alias("r"), r["capacity"].alias("capacity"),
            r["room_id"].alias("room_id"))))).alias("_rooms"))

    def larger(d: Column, c: Column) -> Column:
        """The bits of a weekday's rooms of capacity c or more."""
        return F.aggregate(F.filter("_bits", lambda x: (x["dow"] == d) & (x["capacity"] >= c)), F.lit(0).cast("long"),
                           lambda s, x: s.bitwiseOR(x["bits"]))
    fits = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda d: F.transform(
        F.array_sort(F.array_distinct(F.transform(F.filter("_bits", lambda x: x["dow"] == d), lambda x: x["capacity"]))),
        lambda c: F.struct(c.alias("capacity"), larger(d, c).alias("bits"))))
    best = F.transform(F.sequence(F.lit(0), F.lit(7 * n - 1)), lambda j: F.transform(
        F.array_sort(F.transform(F.filter("_rooms", lambda r: r["day"] * n + r["slot"] == j),
                                 lambda r: F.struct(r["r"].alias("r"), r["capacity"].alias("capacity"), r["room_id"].alias("room_id")))),
        lambda r: F.struct(r["capacity"].alias("capacity"), r["room_id"].alias("room_id"))))
    return week.select("timetable_id", "fit", fits.alias("fits"), best.alias("best"))


def _with_small(big: DataFrame, small: DataFrame, keys: Sequence[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """``big`` joined with a checkpointed table: broadcast if its counted rows are few, else both sides are shuffled by
    key and sorted, never ``big`` itself broadcast to the few tasks of the small table."""
    few = small.count() * row_bytes <= SMALL_BYTES
    return big.join(F.broadcast(small) if few else small.hint("merge"), list(keys), how)


def suggest_slots(entries: DataFrame, clashing_ids: DataFrame, rooms: DataFrame, free: DataFrame,
                  k: int = 2, slots: Slots = STANDARD_SLOTS) -> DataFrame:
    """Up to ``k`` (day, slot, room) moves per clashing entry.

    Candidates: a free slot of the same timetable that is at least as long as
    the entry, whose room is large enough (capacity >= max_students) and fits
    (lab entries need lab rooms), and in which the entry's teacher, if it has
    one, has no other overlapping entry. Ranked: same weekday first, then
    weekday, start, capacity desc, room.

    Plan: availability bitmaps, a bit a teaching slot. A teacher's week is 14
    longs (``busy_bits``), the rooms of a (timetable, fit) a few longs a weekday
    (``room_bits``), and those of each class size that entries ask for are looked
    up once, seven longs a (timetable, fit, size), not once an entry. An entry's
    free slots are ``fits & long enough & ~busy``, its own cell counted out, and
    its moves come from the first k of them (and those that start with the
    k-th), so only its own weekday is listed if that has k, and else at most k
    days: no row per cell, no window over entries. The tables are checkpointed and broadcast if counted to be small, else joined
    by key, so the entries stay spread over all tasks whatever the number of
    timetables. Keeping k rooms a cell is exact: for a fixed cell an entry orders
    rooms by capacity desc, so its best k are among the k largest fitting free
    rooms, and a smaller room can only qualify when those do.
    """
    cells = slot_list(slots)
    n = len(cells)
    if n > 62:
        raise ValueError(f"{n} teaching slots a day; a bitmap holds 62")
    if n == 0:
        nothing = free.where(F.lit(False)).join(rooms.where(F.lit(False)), "room_id")
        return nothing.select(F.lit(None).cast(entries.schema["entry_id"].dataType).alias("entry_id"), F.lit(1).alias("rank"),
                              "dow", "slot_name", "slot_start", "slot_end", "room_id", "capacity")
    ensure_checkpoint_dir(entries.sparkSession)
    # tables of a row a (timetable, fit) and a (timetable, teacher); read twice, counted and joined
    places = room_bits(free, rooms, k, slots).checkpoint(eager=True)
    teachers = busy_bits(entries.where(F.col("faculty_id").isNotNull()), "faculty_id", slots).checkpoint(eager=True)
    fit = F.when(F.col("entry_type") == "lab", F.lit("lab")).otherwise(F.lit("any")).alias("fit")
    # per class size of a (timetable, fit): a long a weekday, the slots in which a free room is large enough
    enough = F.transform("fits", lambda day: F.get(F.filter(day, lambda c: c["capacity"] >= F.col("max_students")), F.lit(0))["bits"])
    sizes = (entries.select("timetable_id", fit, "max_students").distinct().join(places, ["timetable_id", "fit"])
             .select("timetable_id", "fit", "max_students", enough.alias("_enough")).checkpoint(eager=True))
    moving = (entries.join(clashing_ids, "entry_id", "left_semi")
              .select("entry_id", "timetable_id", F.col("dow").alias("cur_dow"), "faculty_id", "max_students", "start_sec",
                      "end_sec", fit))
    moving = _with_small(moving, teachers, ["timetable_id", "faculty_id"], 16 * 8 + 64, "left")
    length = F.col("end_sec") - F.col("start_sec")
    moving = moving.select(
        "*", slot_bits(cells, lambda s, e: e - s >= length).alias("_long"),
        slot_bits(cells, lambda s, e: (s < F.col("end_sec")) & (F.col("start_sec") < e)).alias("_own"))
    moving = _with_small(moving, sizes, ["timetable_id", "fit", "max_students"], 7 * 8 + 96)
    moving = _with_small(moving, places.select("timetable_id", "fit", "best"), ["timetable_id", "fit"], 7 * n * (16 * k + 48) + 64)

    zero = F.lit(0).cast("long")

    def open_bits(d: Column, busy: Column) -> Column:
        return F.coalesce(F.get("_enough", d - 1), zero).bitwiseAND(F.col("_long")).bitwiseAND(F.bitwise_not(F.coalesce(busy, zero)))

    def day(at: Column, d: Column, bits: Column) -> Column:
        return F.struct(at.alias("at"), d.alias("dow"), bits.alias("bits"))
    # what the teacher has on the entry's own day besides the entry itself
    once, twice = F.get("once", F.col("cur_dow") - 1), F.get("twice", F.col("cur_dow") - 1)
    own = open_bits(F.col("cur_dow"), twice.bitwiseOR(once.bitwiseAND(F.bitwise_not("_own"))))
    others = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda d: d != F.col("cur_dow"))
    days = F.concat(F.array(day(F.lit(0), F.col("cur_dow"), F.col("_here"))), F.transform(
        others, lambda d: day(d, d, open_bits(d, F.get("once", d - 1)))))
    # the search ends in the own day, at the first start up to which it has k slots, or after k days with a slot; entries
    # without an open slot end at the generator below: a filter here would be pushed down and computed twice
    upto = [F.col("_here").bitwiseAND(F.lit(sum(1 << i for i in range(n) if cells[i][1] <= s)).cast("long"))
            for s in sorted({s for _, s, _, _ in cells})]
    some = moving.withColumn("_here", own).withColumn("_first", F.coalesce(*(F.when(F.bit_count(x) >= k, x) for x in upto)))
    some = some.withColumn("_open", F.when(
        F.col("_first").isNotNull(), F.array(day(F.lit(0), F.col("cur_dow"), F.col("_first")))).otherwise(
        F.slice(F.filter(days, lambda x: x["bits"] != 0), 1, k)))
    starts = F.array(*(F.lit(int(s)) for _, s, _, _ in cells))
    bit = F.array(*(F.lit(i) for i in range(n)))
    moves = F.flatten(F.transform("_open", lambda x: F.flatten(F.transform(
        F.filter(bit, lambda i: F.call_function("getbit", x["bits"], i) == 1), lambda i: F.transform(
            F.filter(F.get("best", (x["dow"] - 1) * n + i), lambda r: r["capacity"] >= F.col("max_students")),
            lambda r: F.struct(x["at"].alias("at"), F.get(starts, i).alias("slot_start"), (-r["capacity"]).alias("less"),
                               r["room_id"].alias("room_id"), i.alias("slot"), x["dow"].alias("dow"),
                               r["capacity"].alias("capacity")))))))
    names, ends = F.array(*(F.lit(x[0]) for x in cells)), F.array(*(F.lit(int(x[2])) for x in cells))
    return (some.select("entry_id", F.posexplode(F.slice(F.sort_array(moves), 1, k)).alias("_p", "_m"))
            .select("entry_id", (F.col("_p") + 1).alias("rank"), "_m.dow", F.get(names, F.col("_m.slot")).alias("slot_name"),
                    "_m.slot_start", F.get(ends, F.col("_m.slot")).alias("slot_end"), "_m.room_id", "_m.capacity"))


def clash_counts(entries: DataFrame, kinds: Sequence[str] = ("room", "faculty", "section")) -> DataFrame:
    """Number of clash pairs per (kind, timetable, dow, resource) without building a pair.

    A start makes a pair with each entry open just before it. Calm resources (``split_crowded``) are dealt by their key, a
    row per entry, and their starts and ends are sorted and summed where they arrive: no aggregate holds a row per time.

    Crowded resources: for one resource with n valid intervals, let c_f be the number of starts
    strictly before the end of interval f. Every pair is either overlapping or
    one ends at or before the other starts, which gives
    ``pairs = sum_f c_f - n(n+1)/2`` (an interval's own start counts in c_f).
    The sum is taken over start/end *histograms* (one row per distinct time
    per resource, map-side reduced), so the only window runs over at most
    2 x 86 400 rows per resource -- bounded by the clock, not by the data.
    """
    events = F.array(
        F.struct(F.col("start_sec").alias("t"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.col("end_sec").alias("t"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    calm, crowded = split_crowded(resource_rows(entries, kinds))
    met, key = _clock_events(calm)
    met = met.groupBy(*key).agg(F.sum(F.col("k") * F.col("open")).alias("pairs")).select(*_KEY, "pairs")
    h = (crowded.select(*_KEY, F.explode(events).alias("_ev"))
         .groupBy(*_KEY, F.col("_ev.t").alias("t"))
         .agg(F.sum("_ev.s").alias("s"), F.sum("_ev.e").alias("e")))
    before = F.coalesce(F.sum("s").over(
        Window.partitionBy(*_KEY).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = (h.select(*_KEY, "s", (F.col("e") * before).alias("_ec"))
         .groupBy(*_KEY).agg(F.sum("_ec").alias("_sc"), F.sum("s").alias("_n")))
    return met.unionByName(g.select(
        *_KEY, F.expr("cast(_sc - cast(_n as decimal(20,0)) * (_n + 1) div 2 as bigint)").alias("pairs")))


def overlap_runs(entries: DataFrame, kinds: Sequence[str] = ("room", "faculty", "section")) -> DataFrame:
    """C5 in a form that is linear in the entries: maximal runs of overlapping entries per resource.

    Output: kind, timetable_id, dow, resource, start_sec, end_sec, entries, pairs (that ``clash_pairs`` would list), deepest
    (entries at one time). A run is a stretch of the day in which every entry overlaps another one of it. Found by
    gaps and islands over the starts and ends. Calm resources (``split_crowded``) are dealt by their key in one exchange, a
    row per entry; a start makes a pair with each entry open just before it. Crowded ones are reduced to their start
    and end times: per resource at most two rows a second of the day, summed map-side, so one costs its clock times. Ends come before starts of the same second, as
    intervals are half-open; where nothing is open before a start, a run begins. With n starts, and for each end the
    starts of the run before it, pairs = sum of these - n(n+1)/2, as in ``clash_counts``.
    """
    events = F.array(F.struct(F.col("end_sec").alias("t"), F.lit(0).alias("k")), F.struct(F.col("start_sec").alias("t"), F.lit(1).alias("k")))
    calm, crowded = split_crowded(resource_rows(entries, kinds))
    one, key = _clock_events(calm)
    begins = (F.col("k") == 1) & (F.col("open") == 0)
    one = one.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(
        Window.partitionBy(*key).orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)))
    one = (one.groupBy(*key, "run").agg(
        F.min("t").alias("start_sec"), F.max("t").alias("end_sec"), F.sum("k").alias("entries"),
        F.sum(F.col("k") * F.col("open")).alias("pairs"), F.max(F.col("k") * (F.col("open") + 1)).alias("deepest"))
        .where("entries > 1").select(*_KEY, "start_sec", "end_sec", "entries", "pairs", "deepest"))
    h = (crowded.select(*_KEY, F.explode(events).alias("_ev"))
         .groupBy(*_KEY, F.col("_ev.t").alias("t"), F.col("_ev.k").alias("k")).agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*_KEY).orderBy("t", "k")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    sign = F.when(F.col("k") == 1, F.col("n")).otherwise(-F.col("n"))
    starts = F.when(F.col("k") == 1, F.col("n")).otherwise(0)
    h = h.withColumns({"open": F.sum(sign).over(upto), "was": F.coalesce(F.sum(sign).over(before), F.lit(0)),
                       "begun": F.coalesce(F.sum(starts).over(before), F.lit(0))})
    begins = (F.col("k") == 1) & (F.col("was") == 0)
    h = h.withColumn("run", F.sum(F.when(begins, 1).otherwise(0)).over(upto))
    g = h.groupBy(*_KEY, "run").agg(
        F.min("t").alias("start_sec"), F.max("t").alias("end_sec"), F.sum(F.when(F.col("k") == 1, F.col("n"))).alias("entries"),
        F.sum(F.when(F.col("k") == 0, (F.col("n") * F.col("begun")).cast("decimal(38,0)"))).alias("_c"),
        F.min(F.when(F.col("k") == 1, F.col("begun"))).alias("_first"), F.max("open").alias("deepest"))
    pairs = F.expr("cast(_c - cast(entries as decimal(20,0)) * _first - cast(entries as decimal(20,0)) * (entries + 1) div 2 as bigint)")
    return one.unionByName(g.where("entries > 1").select(
        *_KEY, "start_sec", "end_sec", "entries", pairs.alias("pairs"), "deepest"))


def quality(entries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per timetable: entries, clash pairs by kind, score = entries / (entries + clashes), decimal(10,4).

    Without ``pairs`` the counts come from ``clash_counts`` (no pair is built);
    given a pair table (C5 output) they are counted from it.
    """
    n = entries.groupBy("timetable_id").agg(F.count(F.lit(1)).alias("entries"))
    if pairs is None:
        # rows of no timetable join nothing below; said here, so that counts and buckets read the entries in the same way
        per = clash_counts(entries.where(F.col("timetable_id").isNotNull())).groupBy("timetable_id").agg(
            *[F.sum(F.when(F.col("kind") == k, F.col("pairs")).otherwise(0)).cast("long").alias(f"{k}_clashes")
              for k in RESOURCES],
            F.sum("pairs").cast("long").alias("clashes"))
    else:
        per = pairs.groupBy("timetable_id").agg(
            *[F.count_if(F.col("kind") == k).alias(f"{k}_clashes") for k in RESOURCES],
            F.count(F.lit(1)).alias("clashes"))
    j = n.join(per, "timetable_id", "left").na.fill(0, [f"{k}_clashes" for k in RESOURCES] + ["clashes"])
    score = (F.col("entries") / (F.col("entries") + F.col("clashes"))).cast("decimal(10,4)")
    return j.select("timetable_id", "entries", *[f"{k}_clashes" for k in RESOURCES], "clashes",
                    score.alias("fitness_score"))


def weekly_grid(entries: DataFrame, owner: Sequence[str], label: Column) -> DataFrame:
    """One row per (owner, time range), one column per weekday; a cell lists the
    distinct labels at that time, sorted, joined by ' / ' ('' when free).

    A row is one group: its distinct (weekday, label) are a set with map-side
    reduction, so it is bounded by the distinct course-sections at that time of
    the week, not by the number of entries, and one exchange makes the grid.
    """
    owner = list(owner)
    # a cell is its weekday's digit and its label, half the bytes of a struct; others than these have no column
    cell = F.when(F.col("dow").isin(*range(1, 8)), F.concat(F.col("dow").cast("int").cast("string"), label.cast("string")))
    e = entries.select(*owner, "start_sec", "end_sec", cell.alias("_cell"))
    g = e.groupBy(*owner, "start_sec", "end_sec").agg(F.array_sort(F.collect_set("_cell")).alias("_cells"))
    days = [F.array_join(F.transform(F.filter("_cells", lambda c: F.startswith(c, F.lit(str(d)))), lambda c: F.substr(c, F.lit(2))),
                         " / ").alias(_day_col(d)) for d in range(1, 8)]
    return g.select(*owner, slot_text("start_sec", "end_sec").alias("time"), "start_sec", *days)


def weekly_grid_long(entries: DataFrame, owner: Sequence[str], label: Column) -> DataFrame:
    """D11 in long form: one row per (owner, time range, weekday, label), each label once.

    No list and no pivot, so a crowded cell is as many rows as it has labels: the form for large tables.
    """
    return (entries.select(*owner, "start_sec", "end_sec", "dow", label.alias("label")).distinct()
            .select(*owner, slot_text("start_sec", "end_sec").alias("time"), "start_sec", "dow",
                    weekday_name("dow").alias("weekday"), "label"))


def student_entries(enrolments: DataFrame, assignments: DataFrame, entries: DataFrame,
                    term: Sequence[str] = ("academic_year", "semester")) -> DataFrame:
    """D11 for students: student_id, ``term`` and the timetable entries of the courses that the student takes in it.

    enrolments: student_id, course_id, timetable_id (that of the student's program), ``term``; assignments: course_id,
    section, ``term`` (a row for each teacher); entries: timetable_id, course_id, section, and the rest.

    A student sits in one section of a course: the sections that the course has in the term are ordered, and the
    student takes number student_id mod their count. So sections fill evenly, a student keeps the section whoever else
    enrols, and nothing is ranked: the sections of a (course, term) are one row, met by an equi join. The entries are met
    by (timetable, course, section), a key that spreads over all of them.

    Enrolments and seats are stored, so that their shuffle files are gone before the entries are shuffled.
    """
    term = list(term)
    enrolled = stored(enrolments.select("student_id", "course_id", "timetable_id", *term).distinct(), "enrolled")
    sections = (assignments.groupBy("course_id", *term)
                .agg(F.array_sort(F.collect_set("section")).alias("_sections")))  # a course's sections
    at = F.pmod(F.col("student_id"), F.size("_sections")).cast("int")
    seats = stored(enrolled.join(sections, ["course_id", *term])
                   .select("student_id", "course_id", "timetable_id", *term, F.get("_sections", at).alias("section")), "seats")
    return seats.join(entries, ["timetable_id", "course_id", "section"])


def _day_col(d: int) -> str:
    return ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")[d - 1]


__all__ = ["clash_pairs", "clash_flags", "capacity_clashes", "free_slots", "suggest_slots", "quality",
           "weekly_grid", "weekly_grid_long", "overlap_runs", "student_entries", "RESOURCES", "STANDARD_SLOTS"]

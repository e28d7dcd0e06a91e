"""N-gram Jaccard join by vertical partitioning, and the groups of documents that its links form.

All distinct word n-grams stand in one global order: by hash, with those that many documents share
last. The order is cut into fragments. Similar sets share an n-gram among the first of each, so
fragments of these prefixes tell which documents may meet; documents that may are gathered in
groups, hot groups in tiles. In a tile the overlap of every pair is counted fragment by fragment,
as a product of small matrices, and the partial counts are summed per pair. What leaves a tile is
one row for each document, with its least linked class in the tile, never a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import flat_bytes, free_name, map_pieces, pieces, text_column
from .shingles import SHINGLE_WORDS, mix, shingle_sets

# Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
# An n-gram in this many prefixes is hot; the hottest are sent to all tasks. Which n-grams these
# are changes the order and so the work, never the result.
HOT_SETS = 8
HOT_GRAMS = 500_000
# Classes in a tile, and n-grams whose partial overlaps are counted at once.
TILE = 1_024
FRAGMENT = 2_048
# Prefix entries that a task gathers before it hands them over.
_FLUSH = 1 << 21
# Bits of the summary of classes that may have a partner (2 MB at most).
_MEMBER_BITS = 24


def _prefix(n: int) -> int:
    """How many first n-grams of a set meet one of any similar set."""
    return n - -(-PERCENT * n // 100) + 1


def _signature(grams: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = mix(grams).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = mix(np.array([total ^ (np.bitwise_xor.reduce(grams) + np.uint64(len(grams)))], np.uint64))
    return int(total.view(np.int64)[0])


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = flat_bytes(text_column(batch, "text"))
    return shingle_sets(data, offsets, lower=True, size=size)


def classify(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, mark, n, class): set size and a hash of the set, which equal sets share; NULL if empty.

    ``mark`` is a hash of the text as it stands, which tells rows with the same doc_id apart.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = _sets(batch, size)
            return {
                "doc_id": batch.column(0),
                "mark": batch.column(2),
                "n": [len(s) for s in sets],
                "class": [_signature(s) if len(s) else None for s in sets],
            }

        return work

    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return map_pieces(marked, "text", "doc_id long, mark long, n long, class long", make)


def _short(grams: np.ndarray) -> np.ndarray:
    """The upper 48 bits of n-gram hashes, which give their place in the order by hash."""
    return grams >> np.uint64(16)


def _by_fragment(grams: np.ndarray, fragments: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each fragment that has n-grams, and where these are."""
    fragment = (mix(grams) % np.uint64(fragments)).astype(np.int64)
    order = np.argsort(fragment, kind="stable")
    at = np.searchsorted(fragment[order], np.arange(fragments + 1))
    for f, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            yield f, order[a:b]


def hot_grams(docs: DataFrame, size: int, fragments: int) -> np.ndarray:
    """N-grams that stand in many prefixes, ascending, and in how many (two rows).

    Every text is counted; equal sets of one task count once. Of more than ``HOT_GRAMS`` the
    hottest are returned.
    """
    schema = pa.schema([("fragment", pa.int32()), ("grams", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                grams = _short(np.concatenate(held))
                held.clear()
                rows = [(f, _pack48(grams[own])) for f, own in _by_fragment(grams, fragments)]
                columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in pieces(batches, "text"):
            for grams in _sets(batch, size):
                if len(grams):
                    own = _signature(grams)
                    if own not in seen:
                        seen.add(own)
                        held.append(grams[: _prefix(len(grams))])
            if sum(map(len, held)) >= _FLUSH:
                yield from flush()
        yield from flush()

    def count(table: pa.Table) -> pa.Table:
        grams = np.concatenate([_unpack48(g) for g in table.column("grams").to_pylist()])
        found, n = np.unique(grams, return_counts=True)
        hot = n >= HOT_SETS
        return pa.table({"gram": found[hot].astype(np.int64), "n": n[hot]})

    found = (
        docs.select("text")
        .mapInArrow(cut, "fragment int, grams binary")
        .groupBy("fragment")
        .applyInArrow(count, "gram long, n long")
    )
    rows = found.orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).toArrow()
    grams, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(grams)
    return np.stack([grams[order], n[order]]) if len(grams) else np.zeros((2, 0), np.int64)


def _pack48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return np.concatenate([raw, np.zeros((len(raw), 2), np.uint8)], axis=1).view("<u8").ravel()


def _ordered(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first n-grams of a set in the global order, as 48-bit numbers."""
    short = _short(grams)
    rank = np.zeros(len(short), np.int64)
    if hot.shape[1]:
        at = np.minimum(np.searchsorted(hot[0], short.astype(np.int64)), hot.shape[1] - 1)
        rank = np.where(hot[0][at] == short.astype(np.int64), hot[1][at], 0)
    return short[np.lexsort((short, rank))[: _prefix(len(grams))]]


_GROUP_SCHEMA = "group long, class long"


def meeting_groups(docs: DataFrame, hot: np.ndarray, size: int, fragments: int) -> DataFrame:
    """(group, class): classes of which any two similar ones share a group.

    Each prefix entry goes to the fragment of its n-gram with the size of its set and its place in
    it. There a class stays only if another one with the n-gram could still reach the
    overlap that a link needs, and the n-grams of the same least class form one group.
    """
    names = ("classes", "sizes", "grams", "rows", "places")
    schema = pa.schema([("fragment", pa.int32()), *((n, pa.binary()) for n in names)])
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        seen: set[int] = set()
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            classes = np.array([h[0] for h in held], np.int64)
            sizes = np.array([h[1] for h in held], np.uint32)
            lengths = np.array([len(h[2]) for h in held])
            grams = np.concatenate([h[2] for h in held])
            rows = np.repeat(np.arange(len(held), dtype=np.uint32), lengths)
            places = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            held.clear()
            for f, own in _by_fragment(grams, fragments):
                used, row = np.unique(rows[own], return_inverse=True)
                values = [f, classes[used].tobytes(), sizes[used].tobytes(), _pack48(grams[own])]
                values += [row.astype(np.uint32).tobytes(), places[own].astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], field.type) for v, field in zip(values, schema)], schema=schema
                )

        for batch in pieces(batches, "text"):
            for grams in _sets(batch, size):
                if len(grams):
                    own = _signature(grams)
                    if own not in seen:
                        seen.add(own)
                        held.append((own, len(grams), _ordered(grams, order)))
            if sum(len(h[2]) for h in held) >= _FLUSH:
                yield from flush()
        yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        parts = [[], [], [], []]
        for row in zip(*(table.column(c).to_pylist() for c in names)):
            at = np.frombuffer(row[3], np.uint32)
            parts[0].append(_unpack48(row[2]))
            parts[1].append(np.frombuffer(row[0], np.int64)[at])
            parts[2].append(np.frombuffer(row[1], np.uint32)[at].astype(np.int64))
            parts[3].append(np.frombuffer(row[4], np.uint32).astype(np.int64))
        grams, classes, sizes, places = (np.concatenate(p) for p in parts)
        groups, members = _meet(grams, classes, sizes, places)
        return pa.table({"group": groups, "class": members})

    entries = docs.select("text").mapInArrow(
        cut, "fragment int, classes binary, sizes binary, grams binary, rows binary, places binary"
    )
    return entries.groupBy("fragment").applyInArrow(meet, _GROUP_SCHEMA).distinct()


def _meet(grams, classes, sizes, places) -> tuple[np.ndarray, np.ndarray]:
    """Groups and classes from prefix entries of one fragment."""
    order = np.lexsort((classes, sizes, grams))
    grams, classes, sizes, places = grams[order], classes[order], sizes[order], places[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (classes[1:] != classes[:-1])
    grams, classes, sizes, places = grams[new], classes[new], sizes[new], places[new]
    # From this n-gram on, a set can still share ``left`` n-grams; a link with a set of size m needs
    # at least PERCENT / (100 + PERCENT) * (size + m) of them, so m may be up to ``reach``.
    left = sizes - places
    reach = (left * (100 + PERCENT) - PERCENT * sizes) // PERCENT
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, int)
    ends = np.append(starts[1:], len(grams))
    out_group, out_class = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        size, far = sizes[a:b], reach[a:b]
        # Sets up to each reach (they are in order of size), and the two farthest reaches among them.
        k = np.searchsorted(size, far, side="right")
        best = np.maximum.accumulate(far)
        second = _second(far, best)
        top = np.where(k > 0, best[np.maximum(k - 1, 0)], -1)
        next_top = np.where(k > 0, second[np.maximum(k - 1, 0)], -1)
        here = np.arange(b - a) < k
        # A class is no partner of itself: where it holds the farthest reach, the next counts.
        others = np.where(here & (far == top), next_top, top)
        stays = others >= size
        if stays.sum() > 1:
            member = classes[a:b][stays]
            out_group.append(np.full(len(member), member.min()))
            out_class.append(member)
    groups, members = np.concatenate(out_group), np.concatenate(out_class)
    if not len(groups):
        return groups, members
    order = np.lexsort((members, groups))
    groups, members = groups[order], members[order]
    new = np.r_[True, (groups[1:] != groups[:-1]) | (members[1:] != members[:-1])]
    return groups[new], members[new]


def _second(values: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The second largest of each beginning of a row of values, -1 if there is none."""
    before = np.concatenate([[-1], best[:-1]])
    return np.maximum.accumulate(np.minimum(values, before))


def _member_bits(members: DataFrame) -> np.ndarray:
    """A bit for each class hash that is in a group: a summary of bounded size."""
    word = F.shiftrightunsigned("class", 64 - _MEMBER_BITS + 6)
    bit = F.shiftrightunsigned("class", 64 - _MEMBER_BITS).bitwiseAND(F.lit(63)).cast("int")
    one = F.expr("shiftleft(1L, bit)")
    rows = (
        members.select(word.alias("word"), bit.alias("bit"))
        .select("word", one.alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    bits = np.zeros(1 << _MEMBER_BITS - 6, np.int64)
    bits[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return bits


def member_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(class, grams): the sets of classes that are in groups, and perhaps a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_member_bits(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in pieces(batches, "text"):
            found = []
            for grams in _sets(batch, size):
                if not len(grams):
                    continue
                own = _signature(grams)
                place = (own & (1 << 64) - 1) >> 64 - _MEMBER_BITS
                if own not in seen and int(bits[place >> 6]) >> (place & 63) & 1:
                    seen.add(own)
                    found.append((own, _pack48(_short(grams))))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["own", "grams"])

    return docs.select("text").mapInArrow(run, "own long, grams binary")


def _overlaps(sets: list[np.ndarray], rows: slice, columns: slice) -> np.ndarray:
    """Intersection sizes of the sets of two ranges: partial counts by fragment, summed per pair."""
    left, right = sets[rows], sets[columns]
    total = np.zeros((len(left), len(right)), np.float32)
    grams = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    number = np.cumsum(np.r_[True, grams[1:] != grams[:-1]]) - 1
    # N-grams of one set alone add to no overlap.
    several = np.bincount(number) > 1
    number, owner = (np.cumsum(several) - 1)[number[several[number]]], owner[several[number]]
    cuts = np.searchsorted(number, np.arange(0, int(several.sum()) + FRAGMENT, FRAGMENT))
    for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = np.zeros((len(left) + len(right), FRAGMENT), np.float32)
        part[owner[a:b], number[a:b] - f * FRAGMENT] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def _linked(sets: list[np.ndarray], rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    shared = _overlaps(sets, rows, columns).astype(np.int64)
    sizes = np.array([len(s) for s in sets])
    union = sizes[rows][:, None] + sizes[columns][None, :] - shared
    return np.nonzero((shared > 0) & (100 * shared >= PERCENT * union))


def _solve_tile(classes: list[int], sides: list[int], raw: list[bytes], crossed: bool) -> list[tuple[int, int]]:
    """(class, least): for each class of a tile, the least class that it reaches by links there."""
    known = {c: (side, c, grams) for c, side, grams in zip(classes, sides, raw)}
    rows = sorted(known.values(), key=lambda r: r[:2])
    classes = [r[1] for r in rows]
    sets = [_unpack48(r[2]) for r in rows]
    cut = sum(r[0] == 0 for r in rows) if crossed else len(rows)
    left, right = slice(0, cut), slice(cut, len(rows)) if crossed else slice(0, cut)
    if len(rows) < 2 or left.start == left.stop or right.start == right.stop:
        return []
    a, b = _linked(sets, left, right)
    b = b + right.start
    # Least labels spread along the links until none changes.
    least = np.arange(len(classes))
    while True:
        new = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    return [(classes[i], classes[j]) for i, j in enumerate(least.tolist()) if i != j]


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles from rows (group, first, second, side, class, grams) in order of their tiles."""
    tile, rows, out = None, [], []

    def solve() -> None:
        if rows:
            _, classes, sides, raw = zip(*rows)
            out.extend(_solve_tile(classes, sides, raw, tile[1] != tile[2]))
        rows.clear()

    def found() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["class", "least"])

    for batch in batches:
        for group, first, second, side, own, grams in zip(*(c.to_pylist() for c in batch.columns)):
            if (group, first, second) != tile:
                solve()
                tile = (group, first, second)
            rows.append((group, own, side, grams))
        yield found()
    solve()
    yield found()


def linked_classes(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(class, least): links between classes that connect whatever similar classes there are.

    A group of more than ``TILE`` classes is cut into blocks of about half as many; every two
    blocks, and each with itself, meet in a tile of its own.
    """
    sized = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.when(F.col("n") <= TILE, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / TILE)).cast("int")
    placed = (
        groups.join(sized.select("group", blocks.alias("blocks")), "group")
        .withColumn("block", F.pmod(F.xxhash64("class", "group"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "group",
            "class",
            F.least("block", "other").alias("first"),
            F.greatest("block", "other").alias("second"),
            # In a tile of two blocks, rows of the first stand on side 0.
            (F.col("block") > F.col("other")).cast("int").alias("side"),
        )
    )
    filled = placed.join(sets, F.col("class") == F.col("own")).select(
        "group", "first", "second", "side", "class", "grams"
    )
    tiles = filled.repartition("group", "first", "second").sortWithinPartitions("group", "first", "second")
    return tiles.mapInArrow(_solve_tiles, "class long, least long").distinct()


def least_members(links: DataFrame, label: str = "least") -> DataFrame:
    """(class, least): the least class that each class in a link reaches over any number of links.

    In each round every class takes the least label among its neighbours' and then the label of
    that label; rounds end when nothing changes. Each round is a table in the shared folder.
    """
    edges = materialise(
        links.select(F.col("class").alias("a"), F.col(label).alias("b"))
        .unionByName(links.select(F.col(label).alias("a"), F.col("class").alias("b")))
        .distinct(),
        "join-edges",
    )
    labels = materialise(edges.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.col("a")).alias("least")), "join-labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("class")).groupBy("a").agg(F.min("least").alias("near"))
        step = labels.join(near, F.col("class") == F.col("a")).select(
            "class", F.col("least").alias("was"), F.least("least", "near").alias("least")
        )
        jump = labels.select(F.col("class").alias("of"), F.col("least").alias("further"))
        step = materialise(
            step.join(jump, F.col("least") == F.col("of")).select(
                "class", "was", F.least("least", "further").alias("least")
            ),
            "join-labels",
        )
        labels = step.select("class", "least")
        if step.filter(F.col("was") != F.col("least")).isEmpty():
            return labels


def _components(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, n, class, component): a row for each document, labels NULL for empty sets."""
    fragments = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    classified = materialise(classify(docs, size), "join-classes")
    hot = hot_grams(docs, size, fragments)
    groups = materialise(meeting_groups(docs, hot, size, fragments), "join-groups")
    sets = member_sets(docs, groups.select("class").distinct(), size)
    labels = least_members(materialise(linked_classes(groups, sets), "join-links"))
    labels = labels.select(F.col("class").alias("of"), "least")
    return classified.join(labels, F.col("class") == F.col("of"), "left").select(
        "doc_id", "mark", "n", "class", F.coalesce("least", "class").alias("component")
    )


def jaccard_components(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    ``docs`` needs doc_id and text; other columns are ignored. A-Z count as a-z. component_id is the
    least doc_id that links reach, the document's own included. A text without words, or NULL, has
    an empty set and links with nothing; one with fewer words than an n-gram has a set of one.
    Equal sets are one class, however many documents have them. Rows with the same doc_id stay
    separate rows; a document without one has the component of its links, or none. An empty
    table gives an empty table.
    """
    rows = materialise(_components(docs.select(F.col("doc_id").cast("long"), "text"), size), "join-rows")
    known = rows.filter(F.col("component").isNotNull())
    named = known.groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, F.col("component") == F.col("of"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their components.

    Of each component the document with the least doc_id stays, of several with that id the one
    with the least hash of its text, and of equal rows one. Documents without words all stay.
    """
    rows = materialise(_components(docs.select(F.col("doc_id").cast("long"), "text"), size), "join-rows")
    rows = rows.filter(F.col("component").isNotNull())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = rows.groupBy(F.col("component").alias("of")).agg(F.min(rank).alias("first"))
    of_id, of_mark, stays = (free_name(docs.columns, n) for n in ("__id", "__mark", "__stays"))
    judged = rows.join(first, F.col("component") == F.col("of")).select(
        F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark), (rank == F.col("first")).alias(stays)
    )
    counted = judged.groupBy(of_id, of_mark, stays).agg(F.count(F.lit(1)).alias("n"))
    marks = materialise(counted.filter(~F.col(stays) | (F.col("n") > 1)).drop("n"), "join-marks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_mark))
    kept = docs.join(marks, same, "left_anti")
    repeated = marks.filter(F.col(stays))
    if repeated.isEmpty():
        return kept
    once = docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(once)

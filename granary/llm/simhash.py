"""SimHash near-duplicates by meet-in-the-middle ball hashing.

classes: a fingerprint has 64 bits. Two that differ in at most three differ in at most one, half the radius, in one of
their 32-bit halves. So every fingerprint emits each half and the 32 variants one bit away, 66 rows; the variants are
shuffled, those that meet another fingerprint's own half are candidates, and the whole fingerprints verify them.

A half that more than CROWD fingerprints share would make too many pairs. Fingerprints that emit into such a crowded
bucket take the whole ball instead: all 64-bit points one bit (near) or two bits (far) away. Two fingerprints link
exactly if they meet at a point where one is near, so a bucket's members are linked to one near member of it and no
pairs are made. A point has at most 2081 fingerprints around it, so a bucket is bounded whatever the data.

Equal fingerprints are one vertex, whatever ids carry it. Components come from star rounds over tables in the shared
folder; nothing but counts and checksums reaches the driver.

deduplicate: texts that share a share of their distinct shingles (five words and 0.8) differ in about a seventh of the
bits, far beyond any ball over a whole fingerprint. Their fingerprints are longer and cut into tables; in each table two
texts meet that have the same bits there. All that meet are held against each other by 128 bits, whatever their number,
which makes candidate groups, and within a group by the shingles themselves. See candidate_links and find_leaders.

Null and empty texts, and texts without a word, have fingerprint zero and are linked like others. Rows with a null id
get their class's component_id, which is null if no row of the class has an id; deduplicate keeps them all. Repeated
rows stay in classes and share one. Long texts are taken whole, in slices of hashes. An empty table gives an empty
result. Other columns are ignored by classes; deduplicate returns them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from .common import attach, byte_slices, discard, materialize, ship

RADIUS = 3
CROWD = 128
_HASHES_AT_ONCE = 1 << 15

#: A table has at least LEAST_BITS bits, and so many that 2^BUCKET_BITS texts at most share a bucket on average; tables
#: are added until a pair at the least similarity meets in none with at most the chance MISS.
LEAST_BITS, BUCKET_BITS, MISS = 8, 10, 0.01
#: Texts of a bucket that one task holds against each other; a larger bucket is dealt to blocks of half as many, and every
#: two blocks are one cell.
CELL_ROWS = 4096
#: Pairs of a cell that a task holds before it folds them.
PAIRS_AT_ONCE = 1 << 18
#: Of the 128 bits that verify a meeting texts at a similarity of 0.8 differ in 19 on average, unrelated ones in 64.
VERIFY_BITS = 32
#: A sieve has 2^SIEVE_SPARE bits or more for each wanted row, but 2^SIEVE_MOST at most (32 MB), in blocks of 2^10.
SIEVE_SPARE, SIEVE_MOST = 7, 28
#: Rows of a candidate group that one task compares, and leaders that a round takes from a larger group, at first.
GROUP_ROWS, ROUND_LEADERS = 512, 64


def shingles_of(data: bytes, shingle: int) -> tuple[Iterator[bytes], int]:
    """All shingles of a text's UTF-8 bytes, A-Z folded, and their number: the whole sequence where there are fewer words,
    none without a word."""
    words = data.lower().split()
    if not words:
        return iter(()), 0
    if len(words) < shingle:
        return iter((b" ".join(words),)), 1
    return map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)), len(words) - shingle + 1


def fingerprint(data: bytes, shingle: int, seed: int) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes."""
    import xxhash

    shingles, n = shingles_of(data, shingle)
    if not n:
        return 0
    hashes, counts, done = map(lambda s: xxhash.xxh64_intdigest(s, seed), shingles), np.zeros(64, np.int64), 0
    while done < n:
        m = min(_HASHES_AT_ONCE, n - done)
        part = np.fromiter(hashes, "<u8", m)
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(m, 64).sum(axis=0, dtype=np.uint16)
        done += m
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp holds the fingerprint's bits as a signed number."""
    ship(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            found = np.fromiter((fingerprint(t or b"", shingle, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"), pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(compute, f"`{id_col}` {kind}, fp long")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(vertices: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b) of linked fingerprints, enough of them to connect all that are at most RADIUS bits apart.

    vertices: a materialized table (fp), one row a fingerprint.
    """
    whole = F.lit(0xFFFFFFFF).cast("long")
    half = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("half"), v.alias("value")) for k, v in enumerate((F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(whole)))]))
    halves = vertices.select("fp", half.alias("h")).select("fp", (F.shiftleft("h.half", 32).bitwiseOR(F.col("h.value"))).alias("key"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    ball = halves.select("fp", "key", F.explode(flips).alias("flip")).select("fp", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("own"))
    crowded = materialize(halves.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > crowd).withColumn("crowded", F.lit(True)), "crowded")
    if crowded.isEmpty():
        return _verified(ball, halves)
    total = 33 * 2 * vertices.count()
    marked = attach(ball, crowded, ["key"], ["crowded"], "rows", total, "fp")
    calm = marked.filter("crowded is null").drop("crowded")
    dense = marked.filter("crowded").select("fp").distinct()
    return _verified(calm, calm.filter("own").select("fp", "key")).unionByName(full_ball_links(dense))


def _verified(ball: DataFrame, own: DataFrame) -> DataFrame:
    other = own.select(F.col("fp").alias("b"), F.col("key").alias("key_b"))
    # Sizes are estimated before rows are exploded, so a side could be taken for small and broadcast: the hint forbids it.
    met = ball.select(F.col("fp").alias("a"), "key").join(other.hint("merge"), (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (_differ("a", "b") <= RADIUS))
    return met.select("a", "b")


def full_ball_links(vertices: DataFrame) -> DataFrame:
    """(a, b): every fingerprint linked to one that is near a point around both, which each has 2081 of."""
    bits = [1 << i for i in range(64)]
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")
    ones = F.array(*[signed(b) for b in bits])
    # The second bit is the one after the first or later: pairs (i, j) with j > i come from shifting within the word.
    near = vertices.select("fp", F.explode(F.concat(F.array(signed(0)), ones)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), F.lit(True).alias("near"))
    first = vertices.select("fp", F.posexplode(ones).alias("i", "one"))
    far = first.select("fp", F.col("fp").bitwiseXOR(F.col("one")).alias("x"), F.explode(F.slice(ones, F.col("i") + 2, F.lit(64))).alias("two")).select("fp", F.col("x").bitwiseXOR(F.col("two")).alias("point"), F.lit(False).alias("near"))
    met = near.unionByName(far).groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("b"), F.collect_set("fp").alias("members"))
    return met.filter((F.size("members") > 1) & F.col("b").isNotNull()).select(F.explode("members").alias("a"), "b").filter("a <> b").distinct()


def classes(docs: DataFrame, shingle: int = 3, seed: int = 42, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row."""
    rows = materialize(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    vertices = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("rows")), "vertices")
    found = connected_components(links(vertices.select("fp"), crowd))
    rooted = vertices.join(found, F.col("fp") == F.col("item"), "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    roots = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "roots")
    named = attach(rooted, roots, ["root"], ["component_id"], "n", vertices.count(), "fp").select("fp", "rows", "component_id")
    return attach(rows, materialize(named, "classes"), ["fp"], ["component_id"], "rows", rows.count(), id_col)


def differing_share(similarity: float) -> float:
    """The share of bits in which two texts differ on average, by the share of their shingles that they have in common."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(rows: int, similarity: float) -> tuple[int, int]:
    """(bits, tables): the bits grow with the logarithm of the rows, and the tables as that makes a meeting rarer."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(rows, 2))) - BUCKET_BITS)
    meet = (1 - differing_share(similarity)) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th series of numbers from hashes, each well spread over 64 bits."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles_of(data, shingle)[0]), "<u8"))


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """So many 64-bit words; a bit is one if it is set in over half of the hashes' numbers of its word."""
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[at : at + _HASHES_AT_ONCE]
        for k in range(words):
            counts[k] += np.unpackbits(_mixed(part, k).view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > len(hashes)).reshape(-1), bitorder="little").view("<i8")


def signatures(docs: DataFrame, shingle: int, bits: int, tables: int, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, sig, f0, f1, keys) of every row: mark and sig are digests of the text and of its set of shingles, f the
    128 bits that verify, keys the bits of each table under the table's number."""
    ship(docs.sparkSession)
    words = max(2, -(-bits * tables // 64))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in byte_slices(batches, 2):
            sigs, longs, keys = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_set(text or b"", shingle)
                print_ = long_fingerprint(hashes, words)
                sigs.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                longs.append(print_[:2])
                bit = np.unpackbits(print_.view(np.uint8), bitorder="little")[: bits * tables].reshape(tables, bits)
                keys.append(bit @ powers + (np.arange(tables) << bits))
            both = np.stack(longs)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary()), pa.array(both[:, 0]), pa.array(both[:, 1]), flat], names=["id", "mark", "sig", "f0", "f1", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), _mark(text_col).alias("mark"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(compute, f"id {kind}, mark long, sig binary, f0 long, f1 long, keys array<long>")


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def near_labels(f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    """For each row the least row that it is tied to by rows that differ in at most VERIFY_BITS of the 128 bits."""
    n = len(f0)
    labels, pairs, held = np.arange(n), [], 0
    for at in range(0, n, 256):
        apart = np.bitwise_count(f0[at : at + 256, None] ^ f0[None, at:]) + np.bitwise_count(f1[at : at + 256, None] ^ f1[None, at:])
        i, j = np.nonzero(apart <= VERIFY_BITS)
        later = i < j
        pairs.append((i[later] + at, j[later] + at))
        held += len(pairs[-1][0])
        if held < PAIRS_AT_ONCE and at + 256 < n:
            continue
        # Where many are near each other, pairs so far fold into one a row.
        i, j = (np.concatenate(x) for x in zip(*pairs, (labels, np.arange(n)), strict=True))
        pairs, held = [], 0
        while True:
            before = labels.copy()
            np.minimum.at(labels, j, labels[i])
            np.minimum.at(labels, i, labels[j])
            if np.array_equal(before, labels):
                break
    return labels


def candidate_links(vertices: DataFrame) -> DataFrame:
    """(a, b): enough links to connect all texts that meet in a table and differ in at most VERIFY_BITS of the 128 bits.

    Every two members of a bucket are compared in a cell. A cell gives a link a member at most, to the least that it is
    tied to, so no square of a group's size leaves a task.
    """
    points = vertices.select("node", "f0", "f1", F.explode("keys").alias("key"))
    large = points.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS)
    large = large.select(F.col("key").alias("_large"), F.ceil(F.col("n") / (CELL_ROWS // 2)).cast("int").alias("blocks"))
    sized = points.join(F.broadcast(large), F.col("key") == F.col("_large"), "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != own)
    cells = F.transform(others, lambda x: F.struct(F.least(x, own).alias("q"), F.greatest(x, own).alias("c")))
    whole = F.array(F.struct(F.lit(0).alias("q"), F.lit(0).alias("c")))
    placed = sized.select("node", "f0", "f1", "key", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(cells)).alias("cell"))

    def compare(rows: pa.Table) -> pa.Table:
        node = rows["node"].to_numpy()
        order = np.argsort(node)
        node, f0, f1 = node[order], *(rows[c].to_numpy()[order].view(np.uint64) for c in ("f0", "f1"))
        labels = near_labels(f0, f1)
        tied = np.flatnonzero(labels < np.arange(len(labels)))
        return pa.table({"a": node[labels[tied]], "b": node[tied]})

    ship(vertices.sparkSession)
    return placed.groupBy("key", "cell").applyInArrow(compare, "a long, b long").distinct()


def _settle(shingle: int, least: float):  # noqa: ANN202
    """A function over rows (grp, block, role, grows, node, text), sorted, that names each text's leader.

    Within a group and block texts come in order. A text follows the first leader with which it shares enough shingles;
    one without becomes a leader itself if it may (role 0, or a group that is held whole), else it has none yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders, index = None, [], {}
        for batch in byte_slices(batches, 5):
            groups, nodes, names = [], [], []
            for grp, block, role, grows, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, block) != at:
                    at, leaders, index = (grp, block), [], {}
                hashes = shingle_set((text or "").encode(), shingle)
                own = frozenset(hashes.tolist())
                # In any one order of shingles two sets that share enough share one of their first ones.
                head = hashes[: len(hashes) - math.ceil(least * len(hashes)) + 1].tolist()
                near = sorted({k for h in head for k in index.get(h, ())})
                found = next((k for k in near if len(own & leaders[k][1]) >= least * len(own | leaders[k][1])), None)
                if found is None and (role == 0 or grows):
                    found = len(leaders)
                    leaders.append((node, own))
                    for h in head:
                        index.setdefault(h, []).append(found)
                if role == 1 or block == 0:
                    groups.append(grp)
                    nodes.append(node)
                    names.append(None if found is None else leaders[found][0])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (groups, nodes, names)], names=["grp", "node", "leader"])

    return run


def _rows(docs: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row.alias("_row"), F.col(id_col).alias("_row_id"), _mark(text_col).alias("_row_mark"))


def _named(wanted: DataFrame) -> tuple[DataFrame, Column]:
    """wanted (id, mark, ..) and when it names a row. Without the hint whether texts are shuffled would depend on a
    threshold of the session's, and be settled after they are."""
    return wanted.hint("merge"), (F.col("_row_id") == F.col("id")) & (F.col("_row_mark") == F.col("mark"))


def _sieve(wanted: DataFrame) -> tuple[DataFrame, Column]:
    """A bit map (block, words) over hashes of id and mark in wanted, and when it says that a row may be among them.

    It is broadcast, so rows that are not wanted stay where they are: about one in 2^SIEVE_SPARE of them passes, and more
    where the map has its most bits. What passes is still to be held against wanted.
    """
    bits = max(10, min(SIEVE_MOST, math.ceil(math.log2(max(wanted.count(), 1))) + SIEVE_SPARE))

    def place(id_: str, mark: str) -> tuple[Column, Column, Column]:
        slot = F.xxhash64(id_, mark).bitwiseAND(F.lit((1 << bits) - 1))
        part = lambda shift, mask: F.shiftright(slot, shift).bitwiseAND(F.lit(mask)).cast("int")
        return F.shiftright(slot, 10).cast("int"), part(6, 15), part(0, 63)

    block, word, bit = place("id", "mark")
    slots = wanted.select(block.alias("_block"), word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_word") == k, F.col("_bit"))), F.lit(0).cast("long")) for k in range(16)]
    block, word, bit = place("_row_id", "_row_mark")
    return slots.groupBy("_block").agg(F.array(*words).alias("_words")), (block == F.col("_block")) & (F.getbit(F.get("_words", word), bit) == 1)


def _rows_once(docs: DataFrame, wanted: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    """(row, and the columns of wanted) of the rows of docs that wanted (id, mark, copies, ..), a materialized table, names
    by id and text; of rows that repeat both there is one."""
    sieve, may = _sieve(wanted)
    named, same = _named(wanted)
    met = _rows(docs, row, id_col, text_col).join(F.broadcast(sieve), may, "left_semi").join(named, same).drop("_row_id", "_row_mark")
    again = met.filter("copies > 1").groupBy(*wanted.columns).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return met.filter("copies = 1").unionByName(again)


def find_leaders(docs: DataFrame, vertices: DataFrame, shingle: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """(node, leader) of the texts that follow another one: leader is a text that follows none, comes before it, and has
    at least the share of shingles in common with it.

    Texts come in the order of their least ids. A candidate group of up to GROUP_ROWS texts is held by one task. Of a
    larger one every task holds a block and the group's first ROUND_LEADERS open texts; those that follow none of these
    are open in the next round, which takes twice as many leaders, until no text is open.
    """
    groups = connected_components(candidate_links(vertices))
    members = vertices.join(groups, F.col("node") == F.col("item")).select(F.col("component").alias("grp"), "node", "first.*")
    pending = materialize(members, "members")
    schema, tables, leaders, order = "grp long, node long, leader long", [], ROUND_LEADERS, ["id", "mark", "node"]
    while not pending.isEmpty():
        # Where a text goes is settled without it; then it is picked and dealt.
        large = pending.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP_ROWS)
        large = large.select(F.col("grp").alias("_large"), F.ceil(F.col("size") / GROUP_ROWS).cast("int").alias("_blocks"))
        sized = pending.join(F.broadcast(large), F.col("grp") == F.col("_large"), "left")
        first = sized.filter("_blocks IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("_r") <= leaders).select(F.col("node").alias("_first"))
        grows, leads = F.col("_blocks").isNull(), F.col("_first").isNotNull()
        every = F.sequence(F.lit(0), F.col("_blocks") - 1)
        own = F.array(F.when(grows, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("_blocks"))).cast("int"))
        placed = sized.join(first, F.col("node") == F.col("_first"), "left").select(*pending.columns, (~leads).cast("int").alias("role"), grows.alias("grows"), F.when(leads, every).otherwise(own).alias("blocks"))
        placed = materialize(placed, "placed")
        texts = _rows_once(docs, placed, F.col(text_col), id_col, text_col).withColumn("block", F.explode("blocks"))
        dealt = texts.repartition("grp", "block").sortWithinPartitions("grp", "block", "role", *order).select("grp", "block", "role", "grows", "node", F.col("_row").alias("_text"))
        named = materialize(dealt.mapInArrow(_settle(shingle, least), schema), "leaders")
        tables.append(named.filter("leader IS NOT NULL AND leader <> node").select("node", "leader"))
        rest = pending.join(named.filter("leader IS NULL").select(F.col("node").alias("_open")), F.col("node") == F.col("_open"), "left_semi")
        still = materialize(rest, "open")
        discard(pending, placed)
        if len(tables) == 1 and not still.isEmpty():
            # Few texts are left, which later rounds read from a table of their own that has each once.
            left = _rows_once(docs, still, F.col(text_col), id_col, text_col)
            docs = materialize(left.select(F.col("id").alias(id_col), F.col("_row").alias(text_col)), "candidates")
        pending = still
        leaders = min(2 * leaders, GROUP_ROWS)
    return reduce(DataFrame.unionByName, tables) if tables else docs.sparkSession.createDataFrame([], "node long, leader long")


def deduplicate(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies of a row that stays: those with at least that share of distinct shingles.

    Of texts with the same shingles that with the least id stays at most, and one of rows that repeat its id and text.
    Rows with a null id can't be told apart and all stay.
    """
    known = docs.filter(F.col(id_col).isNotNull())
    bits, tables = tables_for(known.count(), least)
    own = ["f0", "f1", "keys"]
    rows = signatures(known, shingle, bits, tables, id_col, text_col).groupBy("id", "mark", "sig", *own).agg(F.count("*").alias("copies"))
    rows = materialize(rows, "signatures")
    vertices = rows.groupBy("sig", *own).agg(F.min(F.struct("id", "mark", "copies")).alias("first"))
    vertices = materialize(vertices.withColumn("node", F.monotonically_increasing_id()), "texts")
    following = find_leaders(known, vertices, shingle, least, id_col, text_col).select(F.col("node").alias("_n"))
    stay = vertices.join(following, F.col("node") == F.col("_n"), "left_anti").select(F.col("first.id").alias("_id"), F.col("first.mark").alias("_of"), F.lit(True).alias("stays"))
    # Only what goes, and what stays once of several, is named; the rest passes. Rows travel as one struct, so no column
    # of theirs can clash with those of the join.
    named = rows.select("id", "mark", "copies").join(stay, (F.col("id") == F.col("_id")) & (F.col("mark") == F.col("_of")), "left").filter("stays IS NULL OR copies > 1")
    named = materialize(named.select("id", "mark", "copies", "stays"), "named")
    discard(rows)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    every, (sieve, may), (gone, same) = _rows(known, whole, id_col, text_col), _sieve(named), _named(named)
    passed = every.join(F.broadcast(sieve), may, "left_anti").select("_row")
    passed = passed.unionByName(every.join(F.broadcast(sieve), may, "left_semi").join(gone, same, "left_anti").select("_row"))
    repeated = named.filter("stays").drop("stays")
    if not repeated.isEmpty():
        passed = passed.unionByName(_rows_once(known, repeated, whole, id_col, text_col).select("_row"))
    return passed.select("_row.*").unionByName(docs.filter(F.col(id_col).isNull()))

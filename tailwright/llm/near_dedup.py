"""Near-duplicate classes by ProbMinHash.

A text is its words (A-Z lower-cased); its shingles are five successive words, weighted by how often they occur (a
text of one to four words is one shingle).  Similarity is the larger of the probability Jaccard of the weighted
shingles and the plain Jaccard of their sets; both are the same where no shingle repeats.  A link is 0.8 or more,
and a class is a component of links.

ProbMinHash: the arrivals of shingle d form a Poisson process of rate w_d, each falling into one of the registers;
a register keeps its first arrival.  Rounds go on only for shingles whose next arrival could still come before the
last register's, so a text costs its shingles plus about m ln m arrivals.  Registers agree with the probability
Jaccard as their chance.  A text with repeated shingles has a second set of registers, in which every shingle has
weight one: they agree with the plain Jaccard as their chance.  Without repeats both sets are the same.

Texts with equal words are one node from the start.  Nodes that agree in all ROWS registers of a band share a
bucket; of buckets with the same members one is looked at.  Every member of a bucket is compared with the bucket's
leader, the member whose own buckets are the largest, which is the nearest thing to the group's original.  Where a
bucket still holds several components, its members of different components are compared inside tasks, tile by tile:
first by their registers alone, then those with a possible partner on their whole texts.  Members of the bucket's
largest component aren't compared with each other, so the tiles grow with the square of the other members' number
only.  A link found joins the two components at once, so a task gives out fewer links than it has components; no
pair within a bucket goes unexamined and no group is paired out.  Every link is verified on the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailwright.llm.components import components
from tailwright.llm.session import bounded, documents, table
from tailwright.llm.textkernel import Block, blocks, mix64, windows

WIDTH, SIMILAR = 5, 0.8
#: Registers of a band, and bands: a pair at 0.8 shares a bucket with probability 0.997.
ROWS, BANDS = 8, 32
REGISTERS = ROWS * BANDS
#: Pairs whose registers agree less than three standard errors below the limit aren't verified (one link in 700 at 0.8).
MAYBE = SIMILAR - 3 * float(np.sqrt(SIMILAR * (1 - SIMILAR) / REGISTERS))
#: Members of a bucket that a task compares with as many others at a time: by registers, and by texts of up to TILE_BYTES.
SIGNED_TILE, TILE, TILE_BYTES = 2048, 512, 4 << 20
#: Members that are compared with their leader in one part.
GROUP = 512
#: Bytes of the ids of dropped rows (with ID_BYTES more for each) up to which every executor gets them all.
SENT_BYTES, ID_BYTES = 128 << 20, 32


def weighted_shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and weight of the distinct shingles of each text, in order of text and hash."""
    starts, ends, first = block.words()
    h = block.hashes(starts, ends, lower=True)
    w, at = windows(h, first, WIDTH)
    doc = np.repeat(np.arange(block.n), np.diff(at))
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        one = mix64(np.array([_fold(h[first[k] : first[k + 1]]) for k in short], np.uint64))
        w, doc = np.concatenate((w, one)), np.concatenate((doc, short))
    order = np.lexsort((w, doc))
    w, doc = w[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], w[begin], np.diff(np.append(begin, len(w)))


def _fold(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = (out * 0x9FB21C651E98DF25 + x) & 0xFFFFFFFFFFFFFFFF
    return out


def signatures(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Registers (texts, REGISTERS) holding shingle hashes, and the number of distinct shingles of each text."""
    doc, h, w = weighted_shingles(block)
    return registers(doc, h, w, block.n), np.bincount(doc, minlength=block.n)


def registers(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Registers (n, REGISTERS) of the shingles of n texts."""
    when = np.full(n * REGISTERS, np.inf)
    held = np.zeros(n * REGISTERS, np.uint64)
    last = np.full(n, np.inf)
    t, k = np.zeros(len(doc)), 0
    rate = w.astype(float)
    while len(doc):
        k += 1
        lot = mix64(h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((lot >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        soon = t < last[doc]
        doc, h, t, rate, lot = doc[soon], h[soon], t[soon], rate[soon], lot[soon]
        cell = doc * REGISTERS + (mix64(lot) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(when, cell, t)
        won = when[cell] == t
        held[cell[won]] = h[won]
        own = np.unique(doc)
        last[own] = when.reshape(-1, REGISTERS)[own].max(1)
    return held.reshape(-1, REGISTERS)


def plain_signatures(doc: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with repeated shingles, and their registers with every weight one."""
    repeats = np.unique(doc[w > 1])
    own = np.isin(doc, repeats)
    return repeats, registers(np.searchsorted(repeats, doc[own]), h[own], np.ones(int(own.sum()), np.int64), len(repeats))


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A bucket hash for each band, which names the band too."""
    part = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + part[:, :, k])
    return out.view(np.int64)


def text_key(raw: bytes | None) -> bytes:
    """128 bits of the words of a text."""
    return hashlib.blake2b(b" ".join((raw or b"").lower().split()), digest_size=16).digest()


def signed(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, key, sig, bands) of every row; a text without words has neither registers nor bands.

    ``sig`` and ``bands`` are those of the weighted shingles, then, if any repeats, of the unweighted ones.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for block in blocks(raw, 1 << 19):
                doc, h, w = weighted_shingles(block)
                sig = registers(doc, h, w, block.n)
                repeats, plain = plain_signatures(doc, h, w)
                bands = bands_of(sig).tolist()
                small = [x.tobytes() for x in mix64(sig).astype(np.uint16)]
                for k, more, extra in zip(repeats.tolist(), mix64(plain).astype(np.uint16), bands_of(plain).tolist(), strict=True):
                    small[k] += more.tobytes()
                    bands[k] = list(dict.fromkeys(bands[k] + extra))
                some = (np.bincount(doc, minlength=block.n) > 0).tolist()
                yield pa.record_batch(
                    [
                        batch.column(0).slice(block.first, block.n),
                        pa.array([text_key(t) for t in raw[block.first : block.first + block.n]], pa.binary()),
                        pa.array([x if ok else None for x, ok in zip(small, some, strict=True)], pa.binary()),
                        pa.array([x if ok else [] for x, ok in zip(bands, some, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["id", "key", "sig", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, key binary, sig binary, bands array<long>")


def similarities(left: list[bytes | None], right: list[bytes | None]) -> np.ndarray:
    """The larger of probability and plain Jaccard for each pair of texts; 0 where a text has no words."""
    out = np.zeros(len(left))
    for at, a in _pair_blocks(left, right):
        doc, h, w = weighted_shingles(a)
        pair, side = doc // 2, doc % 2
        total = np.bincount(doc, w, minlength=a.n)
        order = np.lexsort((side, h, pair))
        pair, h, w, doc = pair[order], h[order], w[order].astype(float), doc[order]
        both = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
        p = pair[both]
        n = a.n // 2
        common = np.bincount(p, minlength=n)
        size = np.bincount(pair, minlength=n) - common
        plain = common / np.maximum(size, 1)
        x, y = w[both] / total[doc[both]], w[both + 1] / total[doc[both + 1]]
        out[at : at + n] = np.maximum(plain, _probability(p, x, y, n))
    return out


def _probability(pair: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Sum over common d of 1 / sum over e of max(x_e / x_d, y_e / y_d), with x and y summing to one over all e.

    With r_e = x_e / y_e, the inner sum for d takes x_e / x_d where r_e >= r_d and y_e / y_d elsewhere; shingles of x
    alone have r infinite and those of y alone have r zero, so prefix sums in order of r give all of them.
    """
    order = np.lexsort((x / y, pair))
    pair, x, y = pair[order], x[order], y[order]
    cx, cy = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(y)))
    begin = np.searchsorted(pair, np.arange(n + 1))
    k = np.arange(len(pair))
    a = begin[pair]
    b = begin[pair + 1]
    only_x, only_y = 1 - (cx[b] - cx[a]), 1 - (cy[b] - cy[a])
    above = (cx[b] - cx[k]) + only_x  # r_e >= r_d, itself included
    below = (cy[k] - cy[a]) + only_y
    return np.bincount(pair, 1 / (np.maximum(above, 0) / x + np.maximum(below, 0) / y), minlength=n)


def _pair_blocks(left: list[bytes | None], right: list[bytes | None], limit: int = 1 << 19) -> Iterator[tuple[int, Block]]:
    held: list[bytes] = []
    size = at = 0
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        held += [a or b"", b or b""]
        size += len(held[-1]) + len(held[-2])
        if size > limit:
            yield at, Block(held, 0)
            held, size, at = [], 0, k + 1
    if held:
        yield at, Block(held, 0)


def _shingles_of(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingles and weights of each text."""
    for block in blocks(texts, 1 << 19):
        doc, h, w = weighted_shingles(block)
        cut = np.searchsorted(doc, np.arange(block.n + 1))
        for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            yield h[a:b], w[a:b]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose ``texts(key, text)`` are similar.

    The texts of all b go to their a, in parts of about GROUP, and that of a comes first in each of them; so an a with
    very many b is many parts, each text is sent once a pair, and that of a is cut into shingles once a part.
    """
    bounded(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            a, b = [], []
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for (lead, key, other), own in zip(names, _shingles_of(batch.column(3).to_pylist()), strict=True):
                if not other:
                    first = own[0].copy(), own[1].copy()
                elif _similar(first, own):
                    a.append(lead), b.append(key)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("key"), F.lit(True).alias("other"))
    leads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("key"), F.lit(False).alias("other"))
    rows = others.unionByName(leads).join(texts.select("key", "text"), "key").repartition("a", "part").sortWithinPartitions("a", "part", "other")
    return rows.select("a", "key", "other", "text").mapInArrow(run, "a binary, b binary")


def _similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two texts, as sorted shingles and weights, reach the limit."""
    if not len(a[0]) or not len(b[0]):
        return False
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][at] == a[0])
    j = at[i]
    if len(i) >= SIMILAR * (len(a[0]) + len(b[0]) - len(i)):
        return True
    if not len(i):
        return False
    x, y = a[1][i] / a[1].sum(), b[1][j] / b[1].sum()
    return _probability(np.zeros(len(i), np.int64), x, y, 1)[0] >= SIMILAR


def _pairs(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of one pair of tiles: a row, and the rows of other components that its registers could link it with, with how
    many agree; components are read from the array of labels that ``_labels`` gives, as it then stands."""
    sigs = rows.column("sig").to_pylist()
    sig = np.frombuffer(b"".join([x[: 2 * REGISTERS] for x in sigs]), np.uint16).reshape(-1, REGISTERS)
    plain = np.frombuffer(b"".join([x[-2 * REGISTERS :] for x in sigs]), np.uint16).reshape(-1, REGISTERS) if any(len(x) > 2 * REGISTERS for x in sigs) else None
    part, label = rows.column("part").to_numpy(), _labels(rows)
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    one, other = np.flatnonzero(part == i), np.flatnonzero(part == j)
    for k in one.tolist():
        rest = other[other > k] if i == j else other
        rest = rest[label[rest] != label[k]]
        near = (sig[rest] == sig[k]).mean(1)
        if plain is not None:
            near = np.maximum(near, (plain[rest] == plain[k]).mean(1))
        own = near >= MAYBE
        if own.any():
            yield k, rest[own], near[own]


def _labels(rows: pa.Table) -> np.ndarray:
    _, label = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)
    return label


def _maybe(rows: pa.Table) -> pa.Table:
    """Of one pair of tiles, the nodes that the registers could link with one of another component."""
    found = np.zeros(rows.num_rows, bool)
    for k, rest, _ in _pairs(rows):
        found[k] = found[rest] = True
    return rows.select(["bucket", "node"]).filter(pa.array(found))


def _tiles(rows: pa.Table) -> pa.Table:
    """Of one pair of tiles, links that join its components."""
    key, text, label = rows.column("node").to_pylist(), rows.column("text"), _labels(rows)
    shingles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in shingles:
            _, h, w = weighted_shingles(Block([text[k].as_py() or b""], 0))
            shingles[k] = h, w
        return shingles[k]

    a, b = [], []
    for k, rest, near in _pairs(rows):
        for m in rest[np.argsort(-near, kind="stable")].tolist():
            if label[m] != label[k] and _similar(of(k), of(m)):
                a.append(key[k]), b.append(key[m])
                label[label == label[m]] = label[k]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def near_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, key, class_id, class_size): one row per row of ``docs``, repeated ids included.

    ``class_id`` is the least id of the class.  Texts without words (null, empty, blank) are copies of each other and
    similar to nothing else.  Null ids are judged like others but name no class unless it has no other id.  Other
    columns are not read.
    """
    made = table(signed(docs, text, id_col), "signed")
    n = made.count()
    nodes = made.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    reps = table(made.where(F.size("bands") > 0).groupBy("key").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")), "reps", n)
    spread = reps.select(F.col("key").alias("node"), F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = table(spread.join(full, "bucket"), "members", n)
    mass = members.groupBy("node").agg(F.sum("n").alias("mass"))
    weighed = members.join(mass, "node").select("bucket", "node", "mass")
    leader = weighed.groupBy("bucket").agg(F.max(F.struct("mass", "node")).alias("lead"))
    pairs = weighed.join(leader, "bucket").select(F.col("lead.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    texts = table(_texts_of(docs, members.select("node").distinct(), text), "texts", n)
    links = table(verified(pairs, texts), "links", n)
    labels = components(links)
    more = table(_open_links(members.select("bucket", "node"), labels, reps.select("key", "sig"), texts, n), "links", n)
    if not more.isEmpty():
        labels = components(table(links.unionByName(more), "links", n, 100_000))
    named_nodes = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named_nodes = table(named_nodes, "nodes", n, 100_000)
    classes = named_nodes.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    of_key = named_nodes.join(classes, "label").select("key", "class_id", "class_size")
    return made.select("id", "key").join(of_key, "key").select(F.col("id").alias(id_col), "key", "class_id", "class_size")


def _texts_of(docs: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """(key, text) of the nodes that share a bucket, one text each."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            keys, new, seen = [text_key(t) for t in raw], [], set()
            for k in keys:
                new.append(k not in seen)
                seen.add(k)
            yield pa.record_batch([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "text"]).filter(pa.array(new))

    keyed = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "key binary, text binary")
    one = keyed.join(keys.withColumnRenamed("node", "key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return one


def _open_links(members: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links between different components that share a bucket; each bucket is dealt out as pairs of tiles.

    Texts are looked up for those members only whose registers leave a link possible; they are of about ``n``
    documents.
    """
    named = table(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named", n)
    per = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2)])
    open_ = per.where("low <> high").groupBy("low", "high", "n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket")
    named = table(named.join(open_, "bucket"), "open", n)
    largest = named.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("largest"))
    named = named.join(largest, "bucket").withColumn("inner", F.col("label") == F.col("largest.label")).drop("largest")
    signed_ = table(named.join(sigs.withColumnRenamed("key", "node"), "node"), "open", n)
    maybe = table(_dealt(signed_, F.lit(1.0 / SIGNED_TILE)).groupBy("bucket", "i", "j").applyInArrow(_maybe, "bucket long, node binary").distinct(), "maybe", n)
    ready = table(signed_.join(maybe, ["bucket", "node"], "left_semi").join(texts.withColumnRenamed("key", "node"), "node"), "open", n)
    return _dealt(ready, F.lit(1.0 / TILE) + F.length("text") / float(TILE_BYTES)).groupBy("bucket", "i", "j").applyInArrow(_tiles, "a binary, b binary").distinct()


def _dealt(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row in all pairs of tiles (i, j) that its tile ``part`` is in; the rows of a tile weigh about one in all.

    A bucket's first tiles hold what is outside its largest component; they meet all tiles, the others only them.
    """
    inner, lot = F.col("inner"), F.xxhash64("node", F.lit(4))
    tiles = lambda own: F.ceil(F.coalesce(F.sum(F.when(own, weight)), F.lit(0.0))).cast("int")
    sizes = rows.groupBy("bucket").agg(tiles(~inner).alias("outer_tiles"), tiles(inner).alias("inner_tiles"))
    outer, all_ = F.col("outer_tiles"), F.col("outer_tiles") + F.col("inner_tiles")
    out = rows.join(sizes, "bucket").where(outer > 0)
    out = out.withColumn("part", (F.when(inner, outer + F.pmod(lot, F.greatest(all_ - outer, F.lit(1)))).otherwise(F.pmod(lot, outer))).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.when(inner, outer).otherwise(all_) - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    # grouping by bucket alone would do for Spark, but not for a bucket of many tiles
    return out.withColumn("tile", F.explode(pairs)).select(*rows.columns, "part", "tile.i", "tile.j").repartition("bucket", "i", "j")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: that of the least id (where ids repeat or are null, one of its rows).

    Only the id and the text are read; all columns are carried along, whatever their names.  The ids to drop are sent to
    every executor while they are at most SENT_BYTES, so that no row moves; more are joined by shuffle, with equal rows.
    """
    found = table(near_classes(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", "id"), "classes")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ready = docs.select(row, F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    if found.where(F.col("id").isNull()).isEmpty() and found.groupBy("id").count().where("count > 1").isEmpty():
        dropped = found.where(F.col("id") != F.col("class_id")).select(F.col("id").alias("dropped"))
        size = dropped.agg(F.coalesce(F.sum(F.length(F.col("dropped").cast("string")) + ID_BYTES), F.lit(0)).alias("size")).first()["size"]
        if size <= SENT_BYTES:
            dropped = F.broadcast(dropped)
        return ready.join(dropped, F.col("id") == F.col("dropped"), "left_anti").select("row.*")
    kept = found.groupBy("class_id").agg(F.min(F.when(F.col("id").eqNullSafe(F.col("class_id")), F.col("key"))).alias("kept"))
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([text_key(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), keys], names=["row", "id", "key"])

    keyed = ready.mapInArrow(run, ready.select("row", "id", F.lit(b"").alias("key")).schema)
    same = (F.col("key") == F.col("kept")) & F.col("id").eqNullSafe(F.col("class_id"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["key"]).select("row.*")


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).drop("key")

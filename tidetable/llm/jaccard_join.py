"""N-gram Jaccard self-join with a prefix tree, and its groups.

Texts with the same set of distinct 5-word shingles are one class; the join runs over classes.
Shingles have one global order: by hash, but those that are frequent in the corpus last. Two sets
with a Jaccard similarity of t or more share one of their first n - ceil(t n) + 1 shingles, so the
classes that have a shingle there form its list, cut where sizes lie too far apart to link. A
list's least class is its anchor, and all lists of one anchor are one block: the copies of a text
share most lists, so a class is in few blocks however many shingles it shares, and any two classes
that can link are together in one.

A block is joined in one task. Its sets, their shingles in one order (those of most sets first),
are a trie. It is gone through once for all sets: at a node, the overlap of every set that is still
in the running with the path is known, so nothing above is counted again; a set goes on only while
the overlap and the length that remains below can bring the overlap needed, and only into subtrees
with another group than its own. No pair leaves the task, only the links that join two groups of
the block: fewer than it has members.

There are two such joins. The first runs over what classes share of their prefixes, with the least
such overlap that a link leaves possible; it makes clusters of classes that may link, and few
classes are left. The second runs over the whole sets of each cluster and makes the links; each set
is moved there once (a cluster too large for a task is taken by blocks instead).

A block too large for a task is cut in parts. Each part is joined by itself, with the anchor; then
the classes outside of the block's largest group meet all parts, so a large group of near copies
costs about as much as it has members, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_string, materialize, raw_bytes, row_slices, table, tidied
from .components import components
from .word_hash import distinct_shingles, mix

#: Similarity as a ratio of whole numbers: 100 * intersection >= 75 * union.
OVER, UNDER = 75, 100
#: A shingle counts as frequent from so many classes on; the list of frequent ones that orders the rest is this long at
#: most (what it leaves out is ordered by hash: more work, same result). Shingles are counted in windows of this many.
FREQUENT, FREQUENT_LIST, WINDOW = 8, 1 << 18, 1 << 22
#: Shingles (and EACH more for every set) that a part of a block holds, on average; bounds a task's memory, not the result.
PART, EACH = 1 << 21, 256
#: Up to so many bytes of wanted classes are told to the scan of texts by broadcast; beyond, by a join.
BROADCAST_BYTES = 32 << 20
#: Elements of a path that the trie's walk takes at once.
STEP = 64

_KEY = "struct<n:bigint,fp:bigint>"


def needed(a, b):
    """The least intersection for which sets of a and b elements are linked."""
    return -(-OVER * (a + b) // (UNDER + OVER))


def prefix_length(n):
    return n - -(-OVER * n // UNDER) + 1


def needed_of_prefixes(a, b):
    """The least overlap of the prefixes of sets of a and b elements that leaves a link possible: all else they share lies
    behind the prefix of one of them."""
    return needed(a, b) - (np.maximum(a, b) - prefix_length(np.maximum(a, b)))


def _print(h: np.ndarray) -> np.int64:
    """A fingerprint of a set that doesn't depend on order."""
    return mix(h.view(np.uint64) ^ np.uint64(0xA5A5F00DBAADC0DE)).sum(dtype=np.uint64).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, sorted distinct shingles) of every row; the text is the last column."""
    for batch in batches:
        texts = as_string(batch.column(batch.num_columns - 1))
        for lo, hi in row_slices(texts):
            h, at = distinct_shingles(*raw_bytes(texts.slice(lo, hi - lo)))
            for i in range(hi - lo):
                yield batch, lo + i, h[at[i] : at[i + 1]]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document's id, set size, fingerprint and text hash. kind 1: a shingle (as id) and in how many classes of a window of the task it is, from 2 on."""
    window: list[np.ndarray] = []
    held, seen = 0, set()
    ids, sizes, prints, hashes = [], [], [], []

    def rows(kind: int, *columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind), pa.int32()), *(pa.array(x, pa.int64()) for x in columns)], ["kind", "id", "n", "fp", "t"])

    def counted() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(window), return_counts=True)
        some = times > 1
        none = np.zeros(int(some.sum()), np.int64)
        return rows(1, values[some], times[some], none, none)

    for batch, i, h in _sets(batches):
        fp = _print(h)
        ids.append(batch.column(0)[i].as_py())
        hashes.append(batch.column(1)[i].as_py())
        sizes.append(len(h))
        prints.append(fp)
        if (fp, len(h)) not in seen:
            seen.add((fp, len(h)))
            window.append(h)
            held += len(h)
        if held > WINDOW:
            yield counted()
            window, held, seen = [], 0, set()
        if len(ids) >= 8192:
            yield rows(0, ids, sizes, prints, hashes)
            ids, sizes, prints, hashes = [], [], [], []
    if window:
        yield counted()
    yield rows(0, ids, sizes, prints, hashes)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From prefix entries sorted by (shingle, n, fp), those of lists with two or more classes, each with the list's anchor.

    Works as a stream: of a list no more than the last entry and the anchor are kept, however long it is.
    """
    last: tuple | None = None  # the entry before, and its anchor
    out_last = False  # whether it went out
    for batch in batches:
        h, n, fp = (batch.column(c).to_numpy() for c in ("h", "n", "fp"))
        if last is not None:
            h, n, fp = (np.concatenate([[x], y]) for x, y in zip(last, (h, n, fp)))
        if not len(h):
            continue
        new = np.ones(len(h), bool)  # not the entry before once more
        new[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (fp[1:] != fp[:-1])
        h, n, fp = h[new], n[new], fp[new]
        begins = np.ones(len(h), bool)
        begins[1:] = (h[1:] != h[:-1]) | (OVER * n[1:] > UNDER * n[:-1])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))
        an, afp = n[at], fp[at]
        if last is not None:
            an[at == 0], afp[at == 0] = last[3], last[4]
        go = ~begins
        go[:-1] |= ~begins[1:]
        if last is not None:
            go[0] &= not out_last
        yield pa.RecordBatch.from_arrays([pa.array(x[go], pa.int64()) for x in (h, n, fp, an, afp)], ["h", "n", "fp", "an", "afp"])
        out_last = bool(go[-1]) or (len(h) == 1 and last is not None and out_last)
        last = h[-1], n[-1], fp[-1], an[-1], afp[-1]


def _fits(a, b):
    return (a * OVER <= b * UNDER) & (b * OVER <= a * UNDER)


class Trie:
    """Sets in one order of their elements, most frequent first, as the paths of a prefix tree.

    Elements of one set alone can't overlap and elements of all sets overlap always, so both are counted and left out of the paths.
    Sets are numbered by the order of their paths; `numbers` tells the place of each in the list given.
    """

    def __init__(self, sets: list[np.ndarray]):
        count = len(sets)
        owner = np.repeat(np.arange(count), [len(s) for s in sets])
        values, code, times = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
        self.common = int((times == count).sum()) if count > 1 else 0
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(values))
        some = (times[code] > 1) & (times[code] < count)
        owner, code = owner[some], rank[code][some]
        order = np.lexsort((code, owner))
        ends = np.searchsorted(owner[order], np.arange(count + 1))
        whole = code[order]
        paths = [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]
        keys = [p.astype(">u4").tobytes() for p in paths]
        self.numbers = np.array(sorted(range(count), key=keys.__getitem__), np.int64)
        self.paths = [paths[i] for i in self.numbers]
        self.length = np.array([len(p) for p in self.paths], np.int64)
        place = np.empty(count, np.int64)
        place[self.numbers] = np.arange(count)
        by_code = np.argsort(code, kind="stable")
        self.owners = place[owner[by_code]]
        self.starts = np.searchsorted(code[by_code], np.arange(len(values) + 1))
        self.shared = np.zeros(count, np.int64)  # of each path, how much it shares with the one before
        for i in range(1, count):
            a, b = self.paths[i - 1], self.paths[i]
            m = min(len(a), len(b))
            apart = np.flatnonzero(a[:m] != b[:m])
            self.shared[i] = apart[0] if len(apart) else m

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """How many of the elements each set has."""
        found = [self.owners[self.starts[c] : self.starts[c + 1]] for c in codes]
        return np.bincount(np.concatenate(found), minlength=len(self.paths))


def joining_links(sets: list[np.ndarray], size: np.ndarray, need: Callable = needed, group: np.ndarray | None = None, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets of different groups, as many as it takes to join all that are linked (a forest): exact, by one walk of their trie.

    sets: distinct elements each. size: what their Jaccard sizes are. need: the overlap that links sets of two sizes, least at one
    end of a range of sizes. group: what is joined already (each set its own group, if not given). probes: the sets that meet all
    others (all, if not given).
    """
    trie, count = Trie(sets), len(sets)
    size = size[trie.numbers]
    root = np.arange(count) if group is None else np.unique(group, return_inverse=True)[1][trie.numbers]
    probing = np.arange(count) if probes is None else np.flatnonzero(np.isin(trie.numbers, probes))
    out: list[tuple[int, int]] = []
    # a node: the sets from lo to hi share a path of `depth`; `who` are in the running, with overlaps `have` along that path
    stack = [(0, count, 0, probing, np.full(len(probing), trie.common))]
    while stack:
        lo, hi, depth, who, have = stack.pop()
        below = root[lo:hi]
        on = (size[who] * OVER <= size[lo:hi].max() * UNDER) & (size[lo:hi].min() * OVER <= size[who] * UNDER)
        if probes is None:
            on &= who < hi - 1  # a pair is met at the later of its two
        if below.min() == below.max():
            on &= root[who] != below[0]
        who, have = who[on], have[on]
        stop = int(trie.shared[lo + 1 : hi].min()) if hi - lo > 1 else int(trie.length[lo])
        least = np.minimum(need(size[who], size[lo:hi].min()), need(size[who], size[lo:hi].max())) - 2  # rounding takes less than 2
        longest, at = int(trie.length[lo:hi].max()), depth
        while len(who):
            on = have + longest - at >= least
            if not on.all():
                who, have, least = who[on], have[on], least[on]
            if at == stop or not len(who):
                break
            step = trie.paths[lo][at : min(stop, at + STEP)]
            have, at = have + trie.hits(step)[who], at + len(step)
        if not len(who):
            continue
        while lo < hi and trie.length[lo] == stop:  # paths that end here
            good = (root[who] != root[lo]) & (have >= need(size[who], size[lo])) & _fits(size[who], size[lo])
            if probes is None:
                good &= who < lo
            for x in who[good]:
                if root[x] != root[lo]:
                    out.append((int(trie.numbers[x]), int(trie.numbers[lo])))
                    root[root == root[x]] = root[lo]
            lo += 1
        if lo < hi:
            cuts = [lo, *(lo + 1 + np.flatnonzero(trie.shared[lo + 1 : hi] == stop)).tolist(), hi]
            stack += [(a, b, stop, who, have) for a, b in zip(cuts[-2::-1], cuts[:0:-1])]
    return out


def _join_parts(need: Callable) -> Callable:
    """The joining links of each part of a block. Rows come sorted by (an, afp, part, other): a part is a stretch of rows."""

    def joined(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        known: dict[tuple[int, int], list] = {}
        for n, fp, comp, probe, data in held:
            row = known.setdefault((n, fp), [comp, False, data])  # a class can be there twice: with repeated rows, or on both sides
            row[1] |= probe
        names, rows = list(known), list(known.values())
        size = np.array([n for n, _ in names], np.int64)
        two_sides = (np.array([x[0] for x in rows], np.int64), np.flatnonzero([x[1] for x in rows])) if key[3] >= 0 else ()
        links = joining_links([np.frombuffer(x[2], "<i8") if isinstance(x[2], bytes) else np.array(x[2], np.int64) for x in rows], size, need, *two_sides)
        side = lambda k: pa.array([{"n": names[x[k]][0], "fp": names[x[k]][1]} for x in links], pa.struct([("n", pa.int64()), ("fp", pa.int64())]))
        return pa.RecordBatch.from_arrays([side(0), side(1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keys = zip(*(part.column(c).to_pylist() for c in ("an", "afp", "part", "other")))
                rows = zip(*(part.column(c).to_pylist() for c in ("n", "fp", "comp", "probe", "data")))
                for k, row in zip(keys, rows):
                    if k != key:
                        if len(held) > 1:
                            yield joined(key, held)
                        held, key = [], k
                    held.append(row)
        if len(held) > 1:
            yield joined(key, held)

    return run


def _joined(dealt: DataFrame, need: Callable) -> DataFrame:
    """The joining links (a, b: structs of n and fp) of all parts; written. dealt: an, afp, part, other, comp, probe, n, fp, data."""
    place = ("an", "afp", "part", "other")
    dealt = dealt.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place)
    return materialize(dealt.mapInArrow(tidied(_join_parts(need)), f"a {_KEY}, b {_KEY}"), "links")


def _prefix_links(own: DataFrame, placed: DataFrame) -> DataFrame:
    """Joining links by what may link. own: n, fp, data, the shingles of a class's prefix that another class of the list has, too."""
    return _joined(placed.join(own, ["n", "fp"]), needed_of_prefixes)


def _whole_links(texts: DataFrame, classes: DataFrame, placed: DataFrame) -> DataFrame:
    """Joining links by whole sets. Each wanted text is scanned once (found by id and text hash) and its set dealt straight to its parts."""
    parts = placed.groupBy("n", "fp").agg(F.collect_list(F.struct("an", "afp", "part", "other", "comp", "probe")).alias("parts"))  # of one class: bounded by its prefix and the parts
    wanted = materialize(parts.join(classes.select("n", "fp", "pick"), ["n", "fp"]).select(F.col("pick.id").alias("pid"), F.col("pick.t").alias("pt"), "n", "fp", "parts"), "wanted")
    size = wanted.agg(F.coalesce(F.sum(64 + 48 * F.size("parts")), F.lit(0))).first()[0]
    met = texts.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, F.col("t").eqNullSafe(F.col("pt")) & F.col("id").eqNullSafe(F.col("pid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch, i, h in _sets(batches):
            key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if key not in seen and key == (len(h), int(_print(h))):
                seen.add(key)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(3)), pa.array([h.astype("<i8").tobytes()], pa.binary())], ["n", "fp", "parts", "data"])

    sets = met.select("n", "fp", "parts", "text").mapInArrow(tidied(run), f"n bigint, fp bigint, parts {wanted.schema['parts'].dataType.simpleString()}, data binary")
    return _joined(sets.select("n", "fp", "data", F.explode("parts").alias("p")).select("p.*", "n", "fp", "data"), needed)


def _parts(weight):
    """In how many parts a block of this weight is cut."""
    return F.greatest(F.ceil(weight / F.lit(float(PART))).cast("int"), F.lit(1))


def _of_blocks(rows: DataFrame, blocks: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of blocks (one row a block; few of them)."""
    return rows.join(F.broadcast(blocks) if blocks.count() * 64 <= BROADCAST_BYTES else blocks, ["an", "afp"], how)


def _join(members: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Joining links of all blocks. members: n, fp, an, afp, weight; written. links_of: those of the parts that it is given."""
    weights = members.groupBy("an", "afp").agg(F.sum("weight").alias("weight"))
    large = materialize(weights.where(F.col("weight") > PART).select("an", "afp", _parts(F.col("weight")).alias("parts")), "large")
    alone = {"other": F.lit(-1), "comp": F.lit(0).cast("bigint"), "probe": F.lit(False)}
    if not large.limit(1).count():
        return links_of(members.drop("weight").withColumns({"part": F.lit(0), **alone}))
    part = F.pmod(F.xxhash64("n", "fp", "afp"), F.col("parts")).cast("int")
    members = _of_blocks(members, large, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    is_anchor = (F.col("n") == F.col("an")) & (F.col("fp") == F.col("afp"))
    anywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = members.withColumn("part", F.explode(F.when(is_anchor, anywhere).otherwise(F.array(part))))
    links = links_of(dealt.select("n", "fp", "an", "afp", "part").withColumns(alone))

    # Parts of one block: the classes outside of the block's largest group meet all of its parts.
    group = components(links).select(F.col("node.n").alias("n"), F.col("node.fp").alias("fp"), F.xxhash64("component").alias("comp"))
    split = members.where("parts > 1").join(group, ["n", "fp"], "left").withColumn("comp", F.coalesce("comp", F.xxhash64(F.struct("n", "fp"))))
    split = materialize(split.withColumn("part", part), "split")
    counts = split.groupBy("an", "afp", "comp").agg(F.sum("weight").alias("weight"))
    most = counts.groupBy("an", "afp").agg(F.max(F.struct("weight", "comp")).alias("most"), F.sum("weight").alias("whole"))
    left = most.select("an", "afp", F.col("most.comp").alias("largest"), (F.col("whole") - F.col("most.weight")).alias("rest")).where("rest > 0")
    left = materialize(left.withColumn("others", _parts(F.col("rest"))), "left")
    rows = _of_blocks(split, left)
    other = F.pmod(F.xxhash64("fp", "n", "afp"), F.col("others")).cast("int")
    here = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("probe", F.lit(False))
    there = rows.where(F.col("comp") != F.col("largest")).withColumn("other", other).withColumn("part", F.explode(anywhere)).withColumn("probe", F.lit(True))
    names = ("n", "fp", "an", "afp", "part", "other", "comp", "probe")
    return links.unionByName(links_of(here.select(*names).unionByName(there.select(*names))))


def _clusters(members: DataFrame, may: DataFrame) -> DataFrame:
    """n, fp, an, afp, weight of the classes that may link: their cluster as their block, or where that is large their blocks as they were."""
    group = components(may).select(F.col("node.n").alias("n"), F.col("node.fp").alias("fp"), F.col("component.n").alias("cn"), F.col("component.fp").alias("cfp"))
    found = materialize(group.withColumn("weight", F.col("n") + EACH), "clusters")
    large = found.groupBy("cn", "cfp").agg(F.sum("weight").alias("whole")).where(F.col("whole") > PART).select(F.col("cn").alias("an"), F.col("cfp").alias("afp"), F.lit(True).alias("large"))
    marked = materialize(_of_blocks(found.withColumnsRenamed({"cn": "an", "cfp": "afp"}), materialize(large, "large"), "left"), "clusters")
    whole = marked.where("large IS NULL").select("n", "fp", "an", "afp", "weight")
    apart = members.select("n", "fp", "an", "afp").join(marked.where("large").select("n", "fp", "weight"), ["n", "fp"])
    return materialize(whole.unionByName(apart), "members")


def print_column(text="text"):
    """The size and the fingerprint of each text's shingle set, as a column (struct of n and fp)."""

    @F.arrow_udf(_KEY)
    def print_of(texts: pa.Array) -> pa.Array:
        sets = [(len(h), _print(h)) for _, _, h in _sets(iter([pa.RecordBatch.from_arrays([as_string(texts)], ["text"])]))]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in sets], pa.int64()), pa.array([f for _, f in sets], pa.int64())], ["n", "fp"])

    return print_of(text)


def near_duplicates(docs: DataFrame, *, text: str = "text", id: str = "doc_id", prints: bool = False) -> DataFrame:
    """id, n_shingles, component_id of every row; with prints, fp (the fingerprint of its set) and node (what names its
    group, where one id has rows in several groups) too.

    Rows are linked when 100 * intersection >= 75 * union of their sets of distinct 5-word shingles (texts of fewer words: the
    whole sequence is one shingle); component_id is the least id a row reaches. A text without words, or null, has an empty set
    and is linked with nothing. Rows of one id with different texts are different rows. A null id stands after all others
    (a component of such rows alone has a null component_id). Sets are compared by 64-bit hashes of their shingles.
    An empty table gives an empty result; other columns of docs play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(text).alias("text"))
    summary = materialize(rows.mapInArrow(tidied(_summaries), "kind int, id bigint, n bigint, fp bigint, t bigint"), "summaries")
    documents = summary.where("kind = 0").select("id", "n", "fp", "t")
    # pick: one row that has the class's set
    classes = materialize(documents.where("n > 0").groupBy("n", "fp").agg(F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "t")).alias("pick")), "classes")
    often = summary.where("kind = 1").groupBy("id").agg(F.sum("n").alias("times")).where(F.col("times") >= FREQUENT)
    frequent = often.orderBy(F.desc("times"), "id").limit(FREQUENT_LIST).toArrow()  # a list of fixed length, for the order alone
    by_hash = np.argsort(frequent["id"].to_numpy())
    listed = spark.sparkContext.broadcast((frequent["id"].to_numpy()[by_hash], len(by_hash) - by_hash))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rank = listed.value  # rank: the more frequent, the larger
        held: list[list[np.ndarray]] = [[], [], []]
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in held], ["h", "n", "fp"])
            for x in held:
                x.clear()
            return out

        for _, _, h in _sets(batches):
            if not len(h):
                continue
            fp = _print(h)
            if (fp, len(h)) in seen:  # copies within a task
                continue
            if len(seen) < 1 << 18:
                seen.add((fp, len(h)))
            p = prefix_length(len(h))
            at = np.searchsorted(names, h)
            at[at == len(names)] = 0
            common = names[at] == h if len(names) else np.zeros(len(h), bool)
            ordered = np.concatenate([h[~common], h[common][np.argsort(rank[at[common]], kind="stable")]]) if common.any() else h
            for x, y in zip(held, (ordered[:p], np.full(p, len(h)), np.full(p, fp))):
                x.append(y)
            size += p
            if size > 1 << 16:
                yield flush()
                size = 0
        if size:
            yield flush()

    entries = rows.select("text").mapInArrow(tidied(prefixes), "h bigint, n bigint, fp bigint")
    dealt = entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h", "n", "fp")
    lists = materialize(dealt.mapInArrow(tidied(_lists), "h bigint, n bigint, fp bigint, an bigint, afp bigint"), "lists")
    own = materialize(lists.groupBy("n", "fp").agg(F.collect_list("h").alias("data")), "own")  # a set's prefix at most
    members = lists.select("n", "fp", "an", "afp").distinct().join(own.select("n", "fp", (F.size("data") + EACH).alias("weight")), ["n", "fp"])
    members = materialize(members.select("n", "fp", "an", "afp", "weight"), "members")
    may = _join(members, lambda placed: _prefix_links(own, placed))
    final = components(_join(_clusters(members, may), lambda placed: _whole_links(rows, classes, placed)))
    ids = classes.select(F.struct("n", "fp").alias("node"), "id")
    least = final.join(ids, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = final.join(least, "component").select(F.col("node.n").alias("n"), F.col("node.fp").alias("fp"), "component", "component_id")
    # one row a class, written, so that documents meet it in one join, whose hot classes (copies) adaptive execution can split
    named = materialize(classes.select("n", "fp", F.col("id").alias("least")).join(of_class, ["n", "fp"], "left"), "named")
    out = documents.join(named, ["n", "fp"], "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "least", "id").alias("component_id"), *([F.col("fp"), F.coalesce("component", F.struct("n", "fp")).alias("node")] if prints else []))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shingle count and the least doc_id of its group of near duplicates (see near_duplicates)."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

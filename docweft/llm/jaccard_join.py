"""N-gram Jaccard self-join: T-occurrence search with DivideSkip over blocks that a prefix filter finds.

The steps, each a Spark job over written tables:

1. ``keys``: every row's set of shingle digests is built from its whole text; its size and a 128-bit key of the set are kept, and
   tokens that are frequent in a stretch of rows are counted. Rows with equal sets are one class; the smallest id stands for it.
2. ``tokens``: two sets that are similar enough share l of the first n - ceil(t n) + l tokens of each, in any order of all
   tokens (l is what ``extra`` gives the smaller one). The order is by digest, frequent tokens last, so that passages many documents
   share are not in a prefix unless the text has little else. Which tokens count as frequent changes the work, never the result.
3. ``members``: tokens that only one class has in its prefix are dropped, and so are classes that have fewer than l others; the
   remaining tokens put the classes that have them into the block named after the smallest of these, and a class stays in the
   blocks that hold most of its tokens, as many as no link can avoid. Blocks above ``block_tokens``
   are cut into chunks, and no task holds more than two chunks.
4. ``links``: the sets of block members are built once more, sent to their tasks and searched there (``Search``), first inside
   each chunk, then between chunks as far as they are not connected (``_across_chunks``). A pair that meets in several blocks is
   compared in the first only. A task returns a forest of its links, never the pairs.
5. The forests' edges are joined to components.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import checked_broadcast, map_texts, slices, stored
from docweft.llm.components import components

#: A set's prefix has one more token for each so many that it has.
EXTRA = 12
#: Parts that a frequent token's rows are dealt into.
PARTS = 64
MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"%d" % i) | 1 for i in range(64)], np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of a text's runs of ``k`` words; of all its words if there are fewer, none without words.

    Words are what ASCII white space leaves, with A-Z in lower case.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    h = w[:n] * MULTIPLIERS[0]
    for i in range(1, k):
        h += w[i : i + n] * MULTIPLIERS[i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that is similar enough."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """Tokens that a set of n has in its prefix besides those that make one shared token certain: so many more are certain."""
    return n // EXTRA


def certain(n: int, percent: int) -> int:
    """Least number of prefix tokens that a set of n shares with the prefix of any set that is similar enough."""
    return 1 + extra(needed(n, percent))


def prefix(tokens: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the order "by digest, frequent ones last": its other and its frequent tokens."""
    size = len(tokens) - needed(len(tokens), percent) + 1 + extra(len(tokens))
    if not len(tokens):
        return tokens, tokens
    at = np.searchsorted(hot, tokens)
    is_hot = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == tokens) if len(hot) else np.zeros(len(tokens), bool)
    cold = tokens[~is_hot][:size]
    return cold, tokens[is_hot][: size - len(cold)]


def list_array(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class _Lists:
    """Inverted lists of one task: for each token that two members or more have, their numbers in ascending order.

    ``of[i]`` and ``at[i]``: member i's lists and its place in each.
    """

    def __init__(self, sets: list[np.ndarray]):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        new = np.r_[True, tokens[1:] != tokens[:-1]]
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        shared = size[number] >= 2
        self.postings = owner[order][shared]
        sizes = size[size >= 2]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        renumber = np.cumsum(size >= 2) - 1
        list_of, place_of = np.full(len(tokens), -1), np.zeros(len(tokens), np.int64)
        list_of[order] = np.where(shared, renumber[number], -1)
        place_of[order[shared]] = np.arange(len(self.postings))
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        has = [x >= 0 for x in np.split(list_of, cuts)]
        self.of = [x[h] for x, h in zip(np.split(list_of, cuts), has, strict=True)]
        self.at = [x[h] for x, h in zip(np.split(place_of, cuts), has, strict=True)]

    def after(self, first: int) -> np.ndarray:
        """For each list the place of its first member from number ``first`` on."""
        low = np.r_[0, np.cumsum(self.postings < first)]
        return self.starts + low[self.ends] - low[self.starts]


def divide(sizes: np.ndarray, t: int) -> int:
    """How many of the lists (sizes, longest first) to treat as long: the split of least estimated work.

    Merging costs an element each; at most (merged elements) / (t - long) members can then still reach t, and
    each of them is probed in the long lists.
    """
    long = np.arange(min(len(sizes), t - 1) + 1)
    merged = sizes.sum() - np.r_[0, np.cumsum(sizes)][long]
    probes = merged / (t - long) * long * 8
    return int(np.argmin(merged + probes))


def heap_merge(lists: list[list[int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The members that ``least`` or more of the ascending lists have, and how many lists have each.

    The heads of the lists are a heap. Where the smallest head is in too few lists, ``least`` - 1 lists are taken off the heap and
    skip by binary search to what is then its smallest head: no member before it can be in enough lists.
    """
    n, at = len(lists), [0] * len(lists)
    heads = [x[0] * n + i for i, x in enumerate(lists)]
    heapify(heads)
    found, have = [], []
    while len(heads) >= least:
        member = heads[0] // n
        taken = []
        while heads and heads[0] // n == member:
            taken.append(heappop(heads) % n)
        if len(taken) >= least:
            found.append(member)
            have.append(len(taken))
            for i in taken:
                at[i] += 1
        else:
            while heads and len(taken) < least - 1:
                taken.append(heappop(heads) % n)
            if not heads:
                break
            smallest = heads[0] // n
            for i in taken:
                at[i] = bisect_left(lists[i], smallest, at[i])
        for i in taken:
            if at[i] < len(lists[i]):
                heappush(heads, lists[i][at[i]] * n + i)
    return np.array(found, np.int64), np.array(have, np.int64)


def merged_counts(postings: np.ndarray, begin: np.ndarray, sizes: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The members (of ``n`` in all) that ``least`` or more of the lists have, and how many lists have each.

    Short lists are merged by a heap. Lists that together have more elements than there are members are not short: nearly every member is in
    some of them, and an array with a place for each member counts them without comparing any.
    """
    if sizes.sum() <= n:
        return heap_merge([postings[a : a + k].tolist() for a, k in zip(begin, sizes, strict=True)], least)
    counts = np.bincount(postings[ranges(begin, sizes)], minlength=n)
    found = np.flatnonzero(counts >= least)
    return found, counts[found]


class Search:
    """T-occurrence search by DivideSkip among the sets of one task.

    ``n_first``: None, or the number of members that are only compared with the others, not among themselves. ``blocked``:
    names of other blocks of each member; two members that share one are compared elsewhere. ``roots``: members of equal root
    are known to be connected and are not compared.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, n_first: int | None = None, blocked: list[list[int]] | None = None, roots: np.ndarray | None = None):
        self.lists, self.percent, self.n_first, self.roots = _Lists(sets), percent, n_first, roots
        self.n = np.array([len(s) for s in sets])
        self.names = [set(x) for x in blocked] if blocked else None
        self.second = None if n_first is None else self.lists.after(n_first)
        self.asking = range(len(sets) if n_first is None else n_first)

    def links(self, q: int, lower: np.ndarray | None = None) -> np.ndarray:
        """Members that link with q: of higher number (or, with ``n_first``, of the others), and those marked in ``lower``.

        A member that links with a set of n needs ``needed(n)`` of its tokens, T: q's long lists are set aside; the short
        ones are merged (``merged_counts``), members with T - (number of long lists) or more stay, and each long list is probed for
        them by binary search, dropping who cannot reach T any more. The work goes by the lengths of q's own lists.
        """
        lists, percent, n = self.lists, self.percent, self.n
        none = np.empty(0, np.int64)
        own, t = lists.of[q], needed(int(n[q]), percent)
        begin = lists.starts[own] if lower is not None else lists.at[q] + 1 if self.second is None else self.second[own]
        end = lists.ends[own]
        some = begin < end
        if np.count_nonzero(some) < t:
            return none
        begin, end = begin[some], end[some]
        order = np.argsort(begin - end, kind="stable")
        begin, sizes = begin[order], (end - begin)[order]
        n_long = divide(sizes, t)
        found, have = merged_counts(lists.postings, begin[n_long:], sizes[n_long:], len(n), t - n_long)
        fits = (100 * n[found] >= percent * n[q]) & (percent * n[found] <= 100 * n[q])
        if lower is not None:
            fits &= (found > q) | (lower[found] & (found != q))
        if self.roots is not None:
            fits &= self.roots[found] != self.roots[q]
        found, have = found[fits], have[fits]
        if self.names and self.names[q] and len(found):
            apart = np.array([self.names[q].isdisjoint(self.names[i]) for i in found.tolist()])
            found, have = found[apart], have[apart]
        for i in range(n_long):
            if not len(found):
                return none
            postings = lists.postings[begin[i] : begin[i] + sizes[i]]
            at = np.minimum(np.searchsorted(postings, found), len(postings) - 1)
            have = have + (postings[at] == found)
            stay = have + (n_long - i - 1) >= t
            found, have = found[stay], have[stay]
        return found[100 * have >= percent * (n[q] + n[found] - have)]


def joined(label: np.ndarray, q: int, linked: np.ndarray) -> bool:
    """Give q, ``linked`` and all that are connected to them the smallest of their labels; whether anything changed."""
    together = np.unique(np.r_[label[linked], label[q]])
    if len(together) > 1:
        label[np.isin(label, together)] = together[0]
    return len(together) > 1


def count_links(search: Search, reps: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest rep that links reach inside the task, and the number of linked rows, of each member: every pair that links is found."""
    links, label = np.zeros(len(reps), np.int64), reps.copy()
    for q in search.asking:
        linked = search.links(q)
        if len(linked):
            links[q] += rows[linked].sum()
            links[linked] += rows[q]
            joined(label, q, linked)
    return label, links


#: Members that a component has at least before its further members need not ask.
MANY = 16


def connect(search: Search, reps: np.ndarray) -> np.ndarray:
    """The smallest rep that links reach inside the task, of each member, without looking for links that connect nothing new.

    Once a component has ``MANY`` members its further ones do not ask: links between two of them change nothing, and the
    members of other components ask for them too. So a group of n near copies costs a few searches, not n.
    """
    label = reps.copy()
    quiet, asked_by = np.zeros(len(reps), bool), None
    for q in search.asking:
        if search.n_first is None:
            if asked_by is not None:
                asked_by = label[asked_by_member]
            if label[q] == asked_by or (asked_by is None and np.count_nonzero(label == label[q]) >= MANY):
                if asked_by is None:
                    asked_by_member, asked_by = q, label[q]
                quiet[q] = True
                continue
        linked = search.links(q, quiet if asked_by is not None else None)
        if len(linked):
            joined(label, q, linked)
    return label


def jaccard_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 75,
    count_links: bool = False,
    hot_rows: int = 50,
    hot_tokens: int = 100_000,
    block_tokens: int = 400_000,
) -> DataFrame:
    """``doc_id, n_shingles, linked, component_id`` for every row of ``docs`` (ids are whole numbers), and with ``count_links`` ``n_links``.

    Two rows link when 100 x intersection >= ``percent`` x union of their shingle sets. ``component_id`` is the smallest id that
    links reach; ``linked`` is true for a row that links with any other, copies included; ``n_links`` counts those rows, for which
    every pair of different texts that links must be found: quadratic in a group of near copies, where components alone are not.
    A row without words has no shingles, no links, and its own id. Rows with equal sets are linked whatever their number.

    Ids are taken as distinct: rows that repeat id and text count as copies of each other; rows that repeat an id with
    different texts are each judged by their own text, but share links where the id stands for a class. A
    row with null id is never the smallest; a class of null ids only has no component (null) and links among itself.
    Whole texts count, however long. Other columns are ignored; an empty table gives no rows.

    ``hot_rows``, ``hot_tokens``: tokens found in so many rows are put last in prefixes, the most frequent ``hot_tokens`` of them
    (the bound of what is broadcast); it steers work only. ``block_tokens``: size of a chunk.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = stored(_keys(given, k), "join-keys")
    rows = keys.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2")
    hot = keys.where("kind = 1").groupBy(F.col("k1").alias("token")).agg(F.sum("n").alias("rows"))
    hot = hot.where(F.col("rows") >= hot_rows).orderBy(F.desc("rows"), "token").limit(hot_tokens)
    sent = spark.sparkContext.broadcast(np.sort(np.array([r["token"] for r in hot.collect()], np.int64)))

    classes = rows.where("n_shingles > 0").groupBy("k1", "k2")
    classes = stored(
        classes.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n")), "join-classes"
    )
    # copies are told by id and set key, so that rows that repeat an id do not hide each other
    repeated = classes.where("size > 1 OR rep IS NULL").select("k1", "k2", "rep")
    copies = rows.join(checked_broadcast(stored(repeated, "join-repeated")), ["k1", "k2"]).where("doc_id IS NULL OR doc_id > rep").select("doc_id", "k1")
    bare = rows.where("n_shingles = 0").select("doc_id", "k1")
    copies = stored(copies.unionByName(bare).distinct(), "join-copies")

    gone = checked_broadcast(copies).alias("c")
    members = stored(_members(given, gone, classes, k, percent, sent), "join-members")
    sized = classes.groupBy("rep").agg(F.max("n").alias("n"), F.sum("size").alias("size"))
    members = stored(members.join(sized, "rep"), "join-sized")
    every = stored(members.groupBy("rep", "size").agg(F.array_sort(F.collect_list("block")).alias("blocks")), "join-blocks")  # a prefix bounds the list
    chunks = stored(_chunks(members, block_tokens), "join-chunks")
    dealt = members.join(chunks, "block").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))

    def linked_in(tasks: DataFrame, roots: DataFrame | None, name: str) -> DataFrame:
        """Links in tasks (``rep, block, a, b, side``), apart from those between members of one root."""
        plan = tasks.groupBy("rep").agg(F.collect_list(F.struct("block", "a", "b", "side")).alias("tasks")).join(every, "rep")
        plan = plan.join(roots.withColumnRenamed("node", "rep"), "rep", "left") if roots else plan.withColumn("root", F.lit(None).cast("long"))
        return stored(_links(given, stored(plan.select("rep", "size", "root", "tasks", "blocks"), f"{name}-plan"), k, percent, count_links), name)

    if count_links:
        found = linked_in(_all_pairs(dealt), None, "join-links")
    else:
        own = dealt.select("rep", "block", F.col("own").alias("a"), F.col("own").alias("b"), F.lit(0).alias("side"))
        found = linked_in(own, None, "join-links")
        if not chunks.where("chunks > 1").isEmpty():
            found = _across_chunks(dealt.where("chunks > 1"), found, linked_in, block_tokens)
    roots = _roots(found)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    if count_links:
        known = known.join(links, "rep", "left")
    out = rows.join(known.drop("n"), ["k1", "k2"], "left")
    linked = (F.col("n_shingles") > 0) & (F.col("root").isNotNull() | (F.col("size") > 1))
    cols = ["doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), linked.alias("linked")]
    if count_links:
        n_links = F.coalesce(F.col("links") + F.col("size") - 1, F.col("size") - 1, F.lit(0))
        cols.append(F.when(F.col("n_shingles") > 0, n_links).otherwise(0).cast("long").alias("n_links"))
    return out.select(*cols, F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "rep")).alias("component_id"))


def _roots(found: DataFrame) -> DataFrame:
    return components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))


def _chunks(members: DataFrame, block_tokens: int) -> DataFrame:
    """``block, chunks`` of blocks with two members or more."""
    sums = members.groupBy("block").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias("chunks"), F.count(F.lit(1)).alias("rows"))
    return sums.where("rows > 1").select("block", F.greatest(F.lit(1), "chunks").alias("chunks"))


def _all_pairs(dealt: DataFrame) -> DataFrame:
    """Each member in every pair of chunks of its block that its own chunk is in."""
    both = F.struct(
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side")
    )
    every = dealt.select("rep", "block", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("other"))
    return every.select("rep", "block", both.alias("t")).select("rep", "block", "t.a", "t.b", "t.side")


#: Members of a component in a chunk that stand for it when chunks are compared first.
FEW = 4


def _across_chunks(dealt: DataFrame, found: DataFrame, linked_in, block_tokens: int) -> DataFrame:
    """``found`` with the links between chunks of large blocks, as far as they connect anything.

    A few members of each large component of a chunk are compared first, which connects the parts of a group of near copies.
    Then members are dealt anew by their component: one that fills chunks of its own is not compared with itself any more, so a
    group of n near copies is compared with what else the block holds, not n times with itself.
    """
    roots = stored(_roots(found), "join-roots")

    def rooted(known: DataFrame) -> DataFrame:
        return dealt.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    part = Window.partitionBy("block", "own", "root")  # at most a chunk
    place = F.row_number().over(part.orderBy("rep"))
    few = rooted(roots).withColumns({"many": F.count(F.lit(1)).over(part), "place": place}).where((F.col("many") >= MANY) & (F.col("place") <= FEW))
    few = stored(few.select("rep", "block", "n"), "join-few")
    some = few.join(_chunks(few, block_tokens), "block").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    found = found.unionByName(linked_in(_all_pairs(some), roots, "join-few-links"))

    roots = stored(_roots(found), "join-roots")
    rest = stored(rooted(roots).select("rep", "block", "n", "root"), "join-rest")
    sums = rest.groupBy("block", "root").agg(F.sum("n").alias("tokens"))
    sums = sums.withColumn("large", F.col("tokens") > block_tokens)
    mixed = F.sum(F.when(~F.col("large"), F.col("tokens"))).alias("mixed")
    sums = sums.join(sums.groupBy("block").agg(F.count(F.lit(1)).alias("roots"), mixed), "block").where("roots > 1")
    sums = stored(sums, "join-parts")
    n_chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block_tokens))
    # chunks of many small components count from 0; those of a large one are told by a digest
    small = F.pmod(F.xxhash64("root"), n_chunks("mixed"))
    own = F.xxhash64("root", F.pmod(F.xxhash64("rep"), n_chunks("tokens"))).bitwiseAND(F.lit(2**61 - 1)) + F.lit(2**61)
    again = rest.join(sums.select("block", "root", "tokens", "large", "mixed"), ["block", "root"])
    again = stored(again.select("rep", "block", F.when(F.col("large"), own).otherwise(small).alias("chunk"), F.when(F.col("large"), F.col("root")).alias("whole")), "join-again")
    held = stored(again.select("block", "chunk", "whole").distinct(), "join-again-chunks")
    other = held.withColumnsRenamed({"chunk": "b", "whole": "whole_b"})
    pairs = held.where("whole IS NULL").join(other, "block").where("whole_b IS NOT NULL OR chunk <= b").select("block", F.col("chunk").alias("a"), "b")
    wholes = held.where("whole IS NOT NULL").select("block", "whole").distinct()
    apart = wholes.join(wholes.withColumnRenamed("whole", "whole_b"), "block").where("whole < whole_b")
    apart = apart.join(held, ["block", "whole"]).join(other.where("whole_b IS NOT NULL"), ["block", "whole_b"]).select("block", F.col("chunk").alias("a"), "b")
    pairs = stored(pairs.unionByName(apart), "join-pairs")
    first = again.withColumnRenamed("chunk", "a").join(pairs, ["block", "a"]).select("rep", "block", "a", "b", F.lit(0).alias("side"))
    second = again.withColumnRenamed("chunk", "b").join(pairs.where("a <> b"), ["block", "b"]).select("rep", "block", "a", "b", F.lit(1).alias("side"))
    return found.unionByName(linked_in(first.unionByName(second), roots, "join-last-links"))


def _set_key(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _keys(given: DataFrame, k: int, stretch: int = 2_000_000, often: int = 4) -> DataFrame:
    """kind 0: ``doc_id, n`` (set size), ``k1, k2`` (set key); kind 1: a token ``k1`` that ``n`` sets of a stretch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "k1", "k2"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        kept: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def frequent() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate([np.empty(0, np.int64), *kept.values()]), return_counts=True)
            tokens, n = tokens[n >= often], n[n >= often]
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([1] * len(n), kinds[0]), none, pa.array(n), pa.array(tokens), none], names=names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                made = []
                for t in texts[a:b]:
                    s = shingles(t, k)
                    key = _set_key(s)
                    made.append((len(s), *key))
                    if len(s) and key not in kept:
                        kept[key] = s
                        size += len(s)
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0] * (b - a), kinds[0]), ids.slice(a, b - a), *[pa.array(c, pa.int64()) for c in cols]], names=names
                )
                if size >= stretch:
                    yield frequent()
                    kept, size = {}, 0
        if kept:
            yield frequent()

    return given.mapInArrow(run, "kind int, doc_id long, n long, k1 long, k2 long")


def _tokens(given: DataFrame, gone: DataFrame, k: int, percent: int, sent) -> DataFrame:
    """``token, rep, part``: the prefix tokens of each class, once; part 0 for all but frequent tokens."""

    def start():
        def score(texts):
            sets = [shingles(t, k) for t in texts]
            parts = [prefix(s, sent.value, percent) for s in sets]
            first = pa.array([_set_key(s)[0] for s in sets], pa.int64())
            return [first, list_array([p[0] for p in parts]), list_array([p[1] for p in parts])]

        return score

    made = map_texts(given, "text", ["doc_id"], "k1 long, cold array<long>, hot array<long>", start).alias("p")
    same = F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.k1") == F.col("c.k1"))
    made = made.join(gone, same, "left_anti").where("doc_id IS NOT NULL")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) + 1
    both = F.concat(
        F.transform("cold", lambda t: F.struct(t.alias("token"), F.lit(0).cast("long").alias("part"))),
        F.transform("hot", lambda t: F.struct(t.alias("token"), part.alias("part"))),
    )
    return made.select(F.explode(both).alias("t"), F.col("doc_id").alias("rep")).select("t.token", "rep", "t.part")


def _members(given: DataFrame, gone: DataFrame, classes: DataFrame, k: int, percent: int, sent) -> DataFrame:
    """``block, rep``: the classes that share enough prefix tokens with others, under the smallest class of each token."""
    spark = given.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        found: list[np.ndarray] = []

        def take(t: np.ndarray, r: np.ndarray, part: np.ndarray) -> None:
            """Whole runs of tokens: (0, smallest class, class) for shared ones; (1, token, class) for frequent ones."""
            if not len(t):
                return
            new = np.r_[True, (t[1:] != t[:-1]) | (part[1:] != part[:-1])]
            size = np.diff(np.r_[np.flatnonzero(new), len(t)])
            hot = part > 0
            keep = np.repeat(size > 1, size) | hot
            if keep.any():
                least = np.repeat(r[new], size)
                found.append(np.stack([hot[keep].astype(np.int64), np.where(hot, t, least)[keep], r[keep]], 1))

        def flush() -> pa.RecordBatch:
            rows, n = np.unique(np.concatenate([np.empty((0, 3), np.int64), *found]), axis=0, return_counts=True)
            found.clear()
            cols = [pa.array(rows[:, 0] > 0), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(cols, names=["hot", "name", "rep", "n"])

        for batch in batches:
            t, r, part = (np.r_[h, batch.column(i).to_numpy()] for i, h in enumerate(held))
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1]))  # the last token may go on in the next batch
            take(t[:cut], r[:cut], part[:cut])
            held = [t[cut:], r[cut:], part[cut:]]
            if sum(map(len, found)) > 500_000:
                yield flush()
        take(*held)
        yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = _tokens(given, gone, k, percent, sent).repartition(parts, "token", "part").sortWithinPartitions("token", "part", "rep")
    shared = stored(ordered.mapInArrow(run, "hot boolean, name long, rep long, n long"), "join-shared")
    needs = F.floor(F.ceil(F.col("n") * percent / 100) / EXTRA) + 1  # ``certain``
    sizes = classes.groupBy("rep").agg(F.min("n").alias("n")).select("rep", needs.alias("needs"))
    enough = shared.groupBy("rep").agg(F.sum("n").alias("shared")).join(sizes, "rep").where("shared >= needs")
    shared = shared.join(enough.select("rep", "needs"), "rep")
    hot = shared.where("hot")
    least = hot.groupBy("name").agg(F.min("rep").alias("block"))
    hot = hot.join(F.broadcast(least), "name").select("block", "rep", "n", "needs")  # at most hot_tokens rows
    both = shared.where("NOT hot").select(F.col("name").alias("block"), "rep", "n", "needs").unionByName(hot)
    both = both.groupBy("rep", "block").agg(F.sum("n").alias("n"), F.first("needs").alias("needs"))
    # A class leaves blocks with fewer than half of the tokens that it shares for certain, smallest first: its partner
    # does the same, so that one such token at least is left in a block that both stay in.
    upto = F.sum("n").over(Window.partitionBy("rep").orderBy("n", "block"))
    return both.withColumn("upto", upto).where("2 * upto > needs - 1").select("block", "rep")


def _links(given: DataFrame, plan: DataFrame, k: int, percent: int, counting: bool) -> DataFrame:
    """``rep, root, links`` of the members of each task that are connected to others there; ``links`` is 0 unless counted."""
    wanted = checked_broadcast(plan).withColumnRenamed("rep", "doc_id")
    rows = given.join(wanted, "doc_id").select("doc_id", "size", "root", "tasks", "blocks", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "a", "b", "side", "rep", "size", "root", "blocks", "tokens"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for batch in batches:
            ids, sizes, roots, tasks, blocks, texts = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            sets: list[np.ndarray] = []

            def made() -> pa.RecordBatch:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] + [list_array(sets)]
                return pa.RecordBatch.from_arrays(arrays, names=names)

            held = 0
            for i, size, root, ts, bs, text in zip(ids, sizes, roots, tasks, blocks, texts, strict=True):
                s = shingles(text, k)
                for t in ts:
                    out.append((t["block"], t["a"], t["b"], t["side"], i, size, root, [b for b in bs if b < t["block"]]))
                    sets.append(s)
                    held += len(s)
                    if held > 1_000_000:
                        yield made()
                        out, sets, held = [], [], 0
            if out:
                yield made()

    sent = rows.mapInArrow(send, "block long, a long, b long, side int, rep long, size long, root long, blocks array<long>, tokens array<long>")
    parts = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(parts, "block", "a", "b").sortWithinPartitions("block", "a", "b", "side", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def solve() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            reps, rows, sides = table["rep"].to_numpy(), table["size"].to_numpy(), table["side"].to_numpy()
            roots = table["root"].combine_chunks()
            roots = None if roots.null_count == len(roots) else np.where(roots.is_null(), reps, roots.fill_null(0).to_numpy())
            tokens = table["tokens"].combine_chunks()
            flat, offsets = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            sets = [flat[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            blocked = table["blocks"].to_pylist()
            # rows that repeat an id and a text stand for their class once
            once = [i for i in range(len(reps)) if i == 0 or reps[i] != reps[i - 1] or sides[i] != sides[i - 1] or not np.array_equal(sets[i], sets[i - 1])]
            if len(once) < len(reps):
                reps, rows, sides, roots = reps[once], rows[once], sides[once], None if roots is None else roots[once]
                sets, blocked = [sets[i] for i in once], [blocked[i] for i in once]
            search = Search(sets, percent, int((sides == 0).sum()) if task[1] != task[2] else None, blocked, roots)
            label, links = count_links(search, reps, rows) if counting else (connect(search, reps), np.zeros(len(reps), np.int64))
            # the smallest of each component is in the result too, so that its links are known
            some = (label != reps) | (links > 0)
            return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(label[some]), pa.array(links[some])], names=["rep", "root", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            begin = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[begin]:
                    continue
                if keys[begin] != task:
                    if len(held) and sum(map(len, held)) > 1:
                        yield solve()
                    task, held = keys[begin], []
                held.append(batch.slice(begin, i - begin))
                begin = i
        if held and sum(map(len, held)) > 1:
            yield solve()

    return dealt.mapInArrow(run, "rep long, root long, links long")

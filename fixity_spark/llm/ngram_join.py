"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.llm import chunks as C
from fixity_spark.llm.common import Scratch, components, free_worker, numbered, own_names
from fixity_spark.llm.words import lower_ascii, mix, ngram_hashes, slices, span_hashes, word_spans

#: Words of a shingle and percent of Jaccard similarity for general use.
WORDS, PERCENT = 5, 80
#: Fragments that the n-gram order is cut into.
FRAGMENTS = 4
#: Leader rounds before the sets that remain are compared with each other.
ROUNDS = 3
#: Sets under one key that are compared with each other as they are; more are told apart by the next of these shingles
#: that they share, counted in the global order. Shingles of one line follow each other there, so the steps widen. An entry
#: dealt anew is a row for each further shingle of its prefix, some hundreds in all steps, so fewer comparisons are cheaper.
PAIRED, SHARED = 1024, (1, 2, 8, 32)


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the document of each.

    A document of fewer words is one shingle, the whole sequence; one without words has none.
    """
    keys, docs = [], []
    for i, j in slices(off):
        part = lower_ascii(raw[off[i] : off[j]])
        start, end, doc = word_spans(part, off[i : j + 1] - off[i])
        h = span_hashes(part, start, end)
        at, found = ngram_hashes(h, doc, words)
        of = doc[at]
        size = np.bincount(doc, minlength=j - i)
        for n in np.unique(size[(size > 0) & (size < words)]):
            at, short = ngram_hashes(h, doc, int(n))
            own = size[doc[at]] == n
            found, of = np.concatenate([found, short[own]]), np.concatenate([of, doc[at][own]])
        order = np.lexsort((found, of))
        found, of = found[order], of[order]
        new = np.append(True, (found[1:] != found[:-1]) | (of[1:] != of[:-1]))[: len(found)]
        keys.append(found[new])
        docs.append(of[new] + i)
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _ask(buckets: int, words: int):
    def ask(batches):
        free_worker()
        for chunk, blobs in C.asking(batches):
            raw, off, _ = C.open_chunk(blobs)
            keys, _ = shingle_sets(raw, off, words)
            keys, n = np.unique(keys, return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            rows = C.messages(chunk, keys, buckets, {"keys": lambda c, k=keys: C.pack_keys(k[c]), "docs": lambda c, n=n: n[c].tobytes()})
            if rows is not None:
                yield rows

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """For each chunk its keys that two documents or more hold, with their frequency.

    Chunks count a key up to 255 times, so the frequency of a very common key is a lower bound; it is the
    same for every document, which is all that an order needs.
    """
    data = table["keys"].to_pylist()
    keys = C.unpack_keys(b"".join(data))
    n = np.frombuffer(C.joined(table["docs"]), np.uint8).astype(np.int64)
    source = np.repeat(np.arange(len(data)), [len(x) // C.SHORT for x in data])
    order = np.argsort(keys, kind="stable")
    begin = C.runs(keys[order])
    total = np.add.reduceat(n[order], begin) if len(begin) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(keys)))
    keep = np.repeat(total > 1, size)
    source, keys, total = source[order][keep], keys[order][keep], np.repeat(total, size)[keep]
    order = np.argsort(source, kind="stable")
    source, keys, total = source[order], keys[order], np.minimum(total[order], 2**32 - 1).astype("<u4")
    cut = C.runs(source)
    chunk, bucket = table["chunk"].to_numpy(), table["bucket"].to_numpy()
    part = lambda x: np.split(x, cut[1:]) if len(cut) else []
    return pa.table({"chunk": pa.array(chunk[source[cut]], pa.int64()), "bucket": pa.array(bucket[source[cut]], pa.int32()), "keys": pa.array([C.pack_keys(k) for k in part(keys)], pa.binary()), "df": pa.array([t.tobytes() for t in part(total)], pa.binary())})


_SETS = "doc_id long, n int, s1 long, s2 long, keys binary, df binary"


def _collect_sets(buckets: int, words: int, percent: int):
    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        """Size and signature of each document's set, and its shared shingles in the global order.

        A document whose shared shingles are too few to reach the similarity with any other carries none.
        """
        columns: dict[str, list] = {x.split()[0]: [] for x in _SETS.split(", ")}
        if left.num_rows:
            raw, off, ids = C.open_chunk(left["blob"].to_pylist())
            keys, doc = shingle_sets(raw, off, words)
            df = np.ones(len(keys), np.int64)
            if right.num_rows:
                known = np.concatenate([C.unpack_keys(k) | np.uint64(b) << np.uint64(8 * C.SHORT) for k, b in zip(right["keys"].to_pylist(), right["bucket"].to_pylist(), strict=True)])
                times = np.frombuffer(C.joined(right["df"]), "<u4").astype(np.int64)
                order = np.argsort(known)
                known, times = known[order], times[order]
                at = np.minimum(np.searchsorted(known, short := C.short_keys(keys, buckets)), len(known) - 1)
                df = np.where(known[at] == short, times[at], 1)
            n = np.bincount(doc, minlength=len(off) - 1)
            shared = np.bincount(doc[df > 1], minlength=len(off) - 1)
            bounds = np.append(0, np.cumsum(n))
            sums = np.zeros((2, len(n)), np.uint64)
            if len(keys):
                full = np.flatnonzero(n)
                sums[0, full] = np.add.reduceat(mix(keys), bounds[full])
                sums[1, full] = np.add.reduceat(mix(keys ^ np.uint64(0x5851F42D4C957F2D)), bounds[full])
            need = (percent * n + 99) // 100
            for i in range(len(n)):
                some = keys[:0], df[:0]
                if n[i] and shared[i] >= need[i]:
                    k, d = keys[bounds[i] : bounds[i + 1]], df[bounds[i] : bounds[i + 1]]
                    held = np.flatnonzero(d > 1)
                    held = held[np.argsort(d[held], kind="stable")]  # keys are sorted already
                    some = k[held], d[held]
                for name, value in zip(columns, [ids[i].as_py(), int(n[i]), int(sums[0, i].astype(np.int64)), int(sums[1, i].astype(np.int64)), some[0].tobytes() or None, some[1].astype("<u4").tobytes() or None], strict=True):
                    columns[name].append(value)
        kinds = {"doc_id": pa.int64(), "n": pa.int32(), "s1": pa.int64(), "s2": pa.int64(), "keys": pa.binary(), "df": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in columns.items()})

    return collect


def _prefixes(percent: int):
    """Entries (key, id, n, at, alone) of the shared part of each set's prefix.

    at is the place in the whole set, alone the number of shingles that no other document has.
    """

    def prefixes(batches):
        for b in batches:
            for doc, n, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                keys = np.frombuffer(data, np.uint64)
                alone = n - len(keys)  # unshared shingles are the rarest and come first
                length = n - (percent * n + 99) // 100 + 1 - alone
                if length > 0:
                    keys = keys[:length]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), doc)), pa.array(np.full(len(keys), n, np.int32)), pa.array(np.arange(alone, alone + len(keys), dtype=np.int32)), pa.array(np.full(len(keys), alone, np.int32))], ["key", "id", "n", "at", "alone"])

    return _batched(prefixes)


def _weigh(batches):
    """Entries by frequency, in a bin for each of the first frequencies and 16 for each doubling after them."""
    total: dict[int, int] = {}
    for b in batches:
        df = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").astype(np.int64)
        shift = np.maximum(np.floor(np.log2(np.maximum(df, 1))).astype(np.int64) - 4, 0)
        values, counts = np.unique((df >> shift) << shift, return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            total[v] = total.get(v, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["df", "n"])


def _batched(rows):
    """Joins the small batches a generator makes."""

    def run(batches):
        held, n = [], 0
        for b in rows(batches):
            held.append(b)
            n += b.num_rows
            if n >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def fragment_cuts(frequencies: list[tuple[int, int]], fragments: int) -> list[tuple[int, int]]:
    """Where to cut the order (frequency, key) for fragments of about equal weight; keys are uniform.

    frequencies: (frequency, entries) in ascending order.
    """
    total, cuts, seen = sum(n for _, n in frequencies), [], 0
    for f, n in frequencies:
        while len(cuts) < fragments - 1 and seen + n >= (want := total * (len(cuts) + 1) / fragments):
            cuts.append((f, int((want - seen) / n * (2**64 - 1))))
        seen += n
    return cuts


def _segments(cuts: list[tuple[int, int]]):
    """Rows (id, fragment, keys): each set cut at the same places of the global order."""

    def segments(batches):
        for b in batches:
            ids, frags, parts = [], [], []
            for doc, keys, df in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                keys, df = np.frombuffer(keys, np.uint64), np.frombuffer(df, "<u4")
                fragment = np.zeros(len(keys), np.int64)
                for f, k in cuts:
                    fragment += (df > f) | ((df == f) & (keys > np.uint64(k)))
                for k in np.unique(fragment).tolist():
                    ids.append(doc)
                    frags.append(k)
                    parts.append(np.sort(keys[fragment == k]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(frags, pa.int32()), pa.array(parts, pa.binary())], ["id", "fragment", "keys"])

    return segments


def _overlaps(batches):
    """Shared keys of the two segments in each row."""
    for b in batches:
        left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
        n = [int(C.member(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)).sum()) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["a", "b", "shared"])


def _links(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that reach the similarity: overlaps are counted fragment by fragment and summed."""
    left = segments.select(F.col("id").alias("a"), "fragment", F.col("keys").alias("left"))
    right = segments.select(F.col("id").alias("b"), "fragment", F.col("keys").alias("right"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "left", "right")
    overlap = both.mapInArrow(_overlaps, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    size = lambda name: sizes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"))
    summed = overlap.join(size("a"), "a").join(size("b"), "b")
    return summed.where(100 * F.col("shared") >= percent * (F.col("n_a").cast("long") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _may_link(percent: int) -> str:
    """Sizes near enough, and enough shingles left after this one, for entries e and f of one key."""
    need = f"(cast({percent} AS long) * (e.n + f.n) + {99 + percent}) div {100 + percent}"
    return f"100L * least(e.n, f.n) >= {percent}L * greatest(e.n, f.n) AND 1 + least(e.n - e.at, f.n - f.at) - 1 >= {need}"


def _has_partner(percent: int) -> str:
    """Whether an entry may link with the smallest set that its key has (least) and its own size allows."""
    smallest = f"greatest(least, (cast({percent} AS long) * n + 99) div 100)"
    return f"n - at >= (cast({percent} AS long) * (n + {smallest}) + {99 + percent}) div {100 + percent}"


def _next_keys(percent: int, level: int):
    """Entries by their key and the shared shingle number `level`, from entries (key, id, n, at, c) and the set's keys.

    Sets that link share at least percent of each, so that shingle is at most level - 1 places behind the prefix.
    at is its place less the level - 1 shared before it. Sets so small that fewer shared shingles are enough keep
    their key as well.
    """

    def further(batches):
        for b in batches:
            for key, doc, n, at, c, alone, data in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                keys = np.frombuffer(data, np.uint64)
                after = at + level - 1
                keys = keys[after - alone : n - (percent * n + 99) // 100 + level - alone]
                new = mix(keys ^ mix(np.full(1, key, np.int64).view(np.uint64))).view(np.int64)
                places = np.arange(after, after + len(keys)) - (level - 1)
                if n * percent <= 100 * (level - 1):
                    new, places = np.append(new, key), np.append(places, at)
                if len(new):
                    yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(np.full(len(new), doc)), pa.array(np.full(len(new), n, np.int32)), pa.array(places.astype(np.int32)), pa.array(np.full(len(new), c))], ["key", "id", "n", "at", "c"])

    return _batched(further)


def _all_pairs(entries: DataFrame, live: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of different components that may link by a key they share, from entries (key, id, n, at, c).

    Keys of more than PAIRED entries are not paired: two sets that link share further shingles, too, so their
    entries are dealt anew by the key and a further one. Only what all steps of SHARED do not tell apart is paired
    whatever its number. An entry that no set of its key can reach goes first.
    """
    prefix = f"n - (cast({percent} AS long) * n + 99) div 100 + {SHARED[-1]} - alone"
    sets = live.selectExpr("id", "n", "keys", "n - length(keys) div 8 AS alone").selectExpr("id", "alone", f"substring(keys, 1, int(8 * ({prefix}))) AS keys")
    pairs = None
    for step, level in enumerate(SHARED, 1):
        for sifted in (False, True):  # counted again without the entries that have no partner
            met = entries.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m"), F.min("n").alias("least")).where("low <> high")
            both = entries.join(met.select("key", "m", "least"), "key")
            entries = both if sifted else both.where(_has_partner(percent)).drop("m", "least")
            if step > 1 and not sifted:
                entries = scratch.write(entries, f"sifted{level}")  # read twice, and dealing anew is what costs
        entries = scratch.write(entries, f"level{level}")
        few = entries if level == SHARED[-1] else entries.where(f"m <= {PAIRED}")
        e, f = few.alias("e"), few.alias("f")
        new = e.join(f, F.expr(f"e.key = f.key AND e.id < f.id AND e.c <> f.c AND {_may_link(percent)}")).select(F.col("e.id").alias("a"), F.col("f.id").alias("b"))
        pairs = new if pairs is None else pairs.unionByName(new)
        hot = entries.where(f"m > {PAIRED}").select("key", "id", "n", "at", "c")
        if level == SHARED[-1] or hot.isEmpty():
            return pairs
        entries = hot.join(sets, "id").select("key", "id", "n", "at", "c", "alone", "keys").mapInArrow(_next_keys(percent, SHARED[step]), "key long, id long, n int, at int, c long")


def _merge_groups(links: DataFrame, component: DataFrame | None, scratch: Scratch, k: int) -> DataFrame:
    """component after more links: they are drawn between the groups found so far, which are few."""
    if component is None:
        return components(links, scratch, f"cc{k}_").select(F.col("node").alias("id"), F.col("component").alias("c"))
    for end in ("a", "b"):
        now = component.select(F.col("id").alias(end), "c")
        links = links.join(now, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    joined = components(links, scratch, f"cc{k}_")
    moved = component.join(joined, component["c"] == joined["node"], "left").select("id", F.coalesce("component", "c").alias("c"))
    return scratch.write(moved.unionByName(joined.select(F.col("node").alias("id"), F.col("component").alias("c"))), f"groups{k}")


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of `words` words, A-Z lower-cased; a shorter text is one
    shingle, a text without words has an empty set. Sets link when 100 * intersection >= percent * union, and
    component_id is the smallest doc_id reachable by links, itself included.

    Equal sets are one class, so copies are never paired. Shingles are ordered globally by frequency, then
    hash. A set can only link if enough of its shingles occur elsewhere; the prefixes of those sets are the
    candidates. For each prefix shingle its sets are first paired with one leader, the set with the fewest
    shingles of its own, as the text that others were copied from has; overlaps of a pair are
    counted separately in each fragment of the order and summed. Sets that the links of ROUNDS leader rounds
    have not brought together, although they share a prefix shingle, are then compared with each other, under
    a shingle of many sets only where they share the next ones, too; so no link between components is lost.
    Links inside a component already found are not looked for.

    Null and blank texts link with nothing. Rows that repeat an id and text are of one class. A null id joins the
    class of its text; where all ids of a class are null, it links with nothing else. An empty table gives no
    rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    held, buckets = C.deal(C.write_chunks(docs, scratch))
    asked = held.mapInArrow(_ask(buckets, words), "bucket int, chunk long, keys binary, docs binary")
    answers = scratch.write(asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, keys binary, df binary"), "answers")
    scratch.tidy()
    sets = scratch.write(held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_collect_sets(buckets, words, percent), _SETS), "sets")
    scratch.drop("answers")
    scratch.drop("chunks")
    scratch.tidy()
    sign = ["n", "s1", "s2"]
    classes = scratch.write(sets.where("n > 0").groupBy(*sign).agg(F.min("doc_id").alias("id")), "classes")
    named = classes.where("id IS NOT NULL").select("id", *sign)
    own = sets.where("keys IS NOT NULL").select(F.col("doc_id").alias("id"), *sign, "keys", "df")
    live = own.join(named, ["id", *sign], "left_semi").dropDuplicates(["id", *sign])
    live = scratch.write(live.select("id", "n", "keys", "df"), "live")
    sizes = live.select("id", "n")
    entries = scratch.write(live.select("id", "n", "keys").mapInArrow(_prefixes(percent), "key long, id long, n int, at int, alone int"), "entries")
    weights = live.select("df").mapInArrow(_weigh, "df long, n long").groupBy("df").agg(F.sum("n").alias("n"))
    frequencies = sorted((r.df, r.n) for r in weights.collect())  # some hundred bins at most
    segments = scratch.write(live.select("id", "keys", "df").mapInArrow(_segments(fragment_cuts(frequencies, FRAGMENTS)), "id long, fragment int, keys binary"), "segments")

    component = tested = None  # component(id, c) of all ids but the smallest of each group
    for k in range(ROUNDS + 1):
        now = entries.withColumn("c", F.col("id")) if component is None else entries.join(component, "id", "left").withColumn("c", F.coalesce("c", "id"))
        spread = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m"), F.min(F.struct((F.xxhash64("id", F.lit(k)) if k else F.col("alone")).alias("turn"), "id", "n", "at", "c")).alias("lead")).where("low <> high")
        opened = scratch.write(now.select("key", "id", "n", "at", "c").join(spread.select("key", "m", "lead"), "key"), f"open{k}")
        size = opened.agg(F.count("*").alias("rows"), F.sum("m").alias("squares")).first()
        if not size.rows:
            break
        last = k == ROUNDS or size.squares <= 4 * size.rows
        if last:
            pairs = _all_pairs(opened.select("key", "id", "n", "at", "c"), live, percent, scratch)
        else:
            e = opened.select("key", "id", "n", "at", "c", "lead").alias("e")
            pairs = e.withColumn("f", F.col("lead")).where(f"id <> f.id AND c <> f.c AND {_may_link(percent).replace('e.', '')}").selectExpr("least(id, f.id) AS a", "greatest(id, f.id) AS b")
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, f"pairs{k}")
        found = scratch.write(_links(pairs, segments, sizes, percent), f"links{k}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        component = _merge_groups(found, component, scratch, k)
        scratch.tidy()
        if last:
            break
    named = classes if component is None else classes.join(component, "id", "left").withColumn("id", F.coalesce("c", "id"))
    named = scratch.write(named.select(*sign, F.col("id").alias("_fx_c")), "named")
    out = sets.select("doc_id", *sign).join(named, sign, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("_fx_c", "doc_id").alias("component_id"))


@own_names
def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with the row of the smallest doc_id of each group alone, every column kept.

    Each row is a document of its own, whether or not its id is null or repeated; a null id is larger than any other.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-kept")
    rows = numbered(docs, scratch)
    groups = jaccard_groups(rows.select(F.col("_fx_row").alias("doc_id"), "text"), words, percent)
    groups = groups.select(F.col("doc_id").alias("_fx_row"), F.col("component_id").alias("_fx_c"))
    shared = scratch.write(groups.where("_fx_row <> _fx_c").select("_fx_row", "_fx_c"), "shared")
    shared = shared.unionByName(shared.select(F.col("_fx_c").alias("_fx_row"), "_fx_c").distinct())
    named = scratch.write(shared.join(rows.select("_fx_row", F.col("doc_id").cast("long").alias("_fx_id")), "_fx_row"), "members")
    first = named.groupBy("_fx_c").agg(F.min(F.struct(F.col("_fx_id").isNull(), "_fx_id", "_fx_row")).getField("_fx_row").alias("_fx_row"))
    gone = scratch.write(named.select("_fx_row").join(first.select("_fx_row"), "_fx_row", "left_anti"), "gone")
    return rows.join(gone, "_fx_row", "left_anti").select(*docs.columns)

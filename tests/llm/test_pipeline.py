from collections import Counter

from llm_helpers import low, words
from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages_on_messy(spark, messy, none):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, messy, "").columns == messy.columns
        assert stage(spark, none, "").count() == 0
    assert P.STAGES[-1][1](spark, none, "").count() == 0


def test_language_stage_drops_texts_without_letters_alone(spark, sample, messy):
    assert P.keep_known_languages(spark, sample, "").count() == sample.count()
    kept = {r.doc_id for r in P.keep_known_languages(spark, messy, "").select("doc_id").collect()}
    assert not {3, 4, 5, 9} & kept


def test_language_stage_keeps_short_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert P.keep_known_languages(spark, docs, "").count() == docs.count()


def test_rows_are_judged_alone(spark, messy):
    kept = [r.text for r in P.keep_known_languages(spark, messy, "").where("doc_id IS NULL").collect()]
    assert kept == ["ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"]
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " tail"), (2, "another text of the same id"), (None, long + " end"), (None, "a text without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [long, "a text without an id", "another text of the same id"]
    assert sorted(r.text for r in P.drop_near_copies(spark, docs, "").collect()) == sorted(want)
    rows = [(5, "copied"), (7, "Copied"), (5, "of its own"), (None, "copied"), (7, "copied"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.drop_exact_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in got) == [("5", "of its own"), ("7", "copied"), ("None", "no id")]


def brute_stages(rows):
    """The texts that exact dedup and then the Jaccard stage keep of (doc_id, text) rows, one set at a time."""
    id_of = lambda r: (r[0] is not None, r[0] or 0)
    by_text = {}
    for r in rows:
        k = low(r[1] or "")
        if k not in by_text or id_of(r) > id_of(by_text[k]):
            by_text[k] = r
    exact = list(by_text.values())

    def shingles(text):
        w = words(low(text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(r[1]) for r in exact], list(range(len(exact)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(exact)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(exact):
        key = (r[0] is None, r[0] or 0)
        if find(i) not in first or key < first[find(i)][0]:
            first[find(i)] = key, r
    return exact, [r for _, r in first.values()]


def test_dedup_stages_equal_brute_force(spark, messy_rows):
    long = [f"w{i}" for i in range(80)]
    rows = [(r[0], r[1]) for r in messy_rows]
    # ids that repeat with other texts, null ids, chains of near copies, and texts with nothing in common
    rows += [(20, " ".join(long)), (20, "a text of its own"), (21, " ".join(long[:-4])), (22, " ".join(long[4:-4])), (None, " ".join(long).upper()), (None, " ".join(long[:-1])), (21, "A TEXT of its own"), (23, "too short"), (None, "Too short"), (24, " ".join(reversed(long)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    exact, near = brute_stages(rows)
    plain = lambda rows: sorted((str(d), low(t or "")) for d, t in rows)
    one = P.drop_exact_copies(spark, docs, "")
    assert plain(one.collect()) == plain(exact)
    assert plain(P.drop_near_copies(spark, docs.sparkSession.createDataFrame(exact, docs.schema), "").collect()) == plain(near)


def test_names_used_inside_may_be_taken(spark, messy):
    names = ["_fx_id", "_fx_row", "_fx_copies", "_fx_sha", "_fx_digest", "_fx_keep", "_FX_n", "_fx_c", "_fx_text", "_fx_copy"]
    docs = messy.select("doc_id", "text", "lang", "source", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {tuple(r) for r in out.select(*names).collect()} == {tuple(range(len(names)))}
    assert P.STAGES[-1][1](spark, docs, "").count() > 0


def test_unclear_texts_go_whatever_the_number_of_languages(spark):
    en = "the house and the dog are in the garden with all of the children of the town"
    de = "das haus und der hund sind im garten mit allen kindern aus der stadt"
    rows = [(i, f"{t} {i}", lang) for i in range(200) for t, lang in ((en, "en"), (de, "de"))]
    rows += [(1000, "", "en"), (1001, None, "de"), (1002, "12 %% 34", "en"), (1003, en, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = P.keep_known_languages(spark, docs, "").collect()
    assert len(kept) == 401 and 1003 in {r.doc_id for r in kept}
    assert P.keep_known_languages(spark, docs.withColumn("lang", F.lit("en")), "").count() == 401


def test_run(spark, sf_dir, sample):
    rows = P.run(spark, sf_dir).collect()
    assert rows
    text = {r.doc_id: r.text for r in sample.collect()}
    kept = {r.doc_id for r in rows}
    assert len({low(text[d]) for d in kept}) == len(kept)
    for bin_id in {r.bin_id for r in rows}:
        docs = [r.doc_id for r in rows if r.bin_id == bin_id]
        assert len(docs) == len(set(docs))
    copies = Counter(r.doc_id for r in rows if r.start == 0)
    assert max(copies.values()) <= 3
    for d, n in copies.items():
        assert sum(r.n_words for r in rows if r.doc_id == d) == n * len(words(text[d]))


def brute_targets(sizes):
    """Words that the mix takes of each source: shares of all words by weight, none above three times its own."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        share = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * share for s in names}
        capped |= over


def test_whole_run_equals_brute_force(spark, sf_dir, sample):
    """Deduplication of what the language stage keeps, targets and copies by brute force, against the rows of run()."""
    clear = [(r.doc_id, r.text, r.source) for r in P.keep_known_languages(spark, sample, sf_dir).collect()]
    source = {d: s for d, _, s in clear}
    near = brute_stages([(d, t) for d, t, _ in clear])[1]
    size = {d: len(words(t)) for d, t in near}
    of_source = Counter()
    for d, n in size.items():
        of_source[source[d]] += n
    target = brute_targets(of_source)
    rows = P.run(spark, sf_dir).collect()
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.n_words
    assert set(taken) <= set(size)
    longest = Counter()
    for d, n in size.items():
        rate = target[source[d]] / of_source[source[d]]
        copies = taken[d] / n if n else 0
        assert copies in (int(rate + 1e-9), -int(-(rate - 1e-9) // 1)), (d, copies, rate)
        longest[source[d]] = max(longest[source[d]], n)
    for s, t in target.items():
        assert abs(sum(taken[d] for d in size if source[d] == s) - t) <= longest[s] + 1

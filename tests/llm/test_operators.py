"""Operators against plain Python, on small tables with nulls, empty and long texts, ties and repeated rows."""

import math
import random
from pathlib import Path

import plain
import pytest
from gatekit.llm import components as C
from gatekit.llm import common, decontam, langid, line_dedup, mixing, near_dup, ngram_lm, paragraphs, quality, toxicity, url_filter
from pyspark.sql import functions as F

# Columns that clash with the names the operators use inside.
CLASHING = "d s n h size line pos key bucket rep component u terms tokens score body index off tp set".split()


def clash() -> dict:
    return {c: F.lit(7) for c in CLASHING}


def some_words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text, source): copies, near copies, repeated lines, odd texts; ids differ."""
    rng = random.Random(5)
    docs, line = [], "The very same line that a good many of these documents hold somewhere"
    for i in range(60):
        w = some_words(rng, rng.randrange(8, 160))
        docs.append((i, " ".join(w[:5]) + "\n" + " ".join(w[5:]), f"src{i % 3}" if i % 10 else None))
    base = some_words(rng, 150)
    for i in range(60, 90):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(150)] = f"x{rng.randrange(99)}"
        docs.append((i, " ".join(w), "src0"))
    docs += [(i, docs[3][1].upper(), "src1") for i in (90, 91)]
    docs += [(i, f"{some_words(rng, 3)}\n  {line.upper() if i % 2 else line}\t\nlast {i}", "src2") for i in range(92, 101)]
    docs += [(101, None, "src1"), (102, "", "src1"), (103, " \n\t ", None), (104, "ab", "src2"), (105, "ab", "src2")]
    docs += [(106, " ".join(some_words(rng, 30_000, 5_000)), "src0"), (107, "\n" * 50, "src0"), (108, "É\u00a0É ünïcode   " * 4, "src0")]
    return docs


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, source string").withColumns(clash()).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)]
    df = spark.createDataFrame([*links, (None, 3), (4, None), (9, 9)], "a long, b long")
    want = {x: c for x, c in plain.components(links).items() if any(x in e and e[0] != e[1] for e in links)}
    for one_task in (C.ONE_TASK, 0):
        got = C.connected_components(df, one_task=one_task).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
        assert not C.connected_components(df.limit(0), one_task=one_task).collect()


def test_near_duplicates(docs, texts, empty):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    want = plain.near_components([(d, t) for d, t, _ in texts])
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(plain.shingles(t)) for (d, t, _) in texts for r in [got[d]])
    assert len(set(want.values())) < len(want) - 10
    assert not near_dup.near_duplicates(empty).collect()


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "z y x w v u t s"
    rows = [(5, a), (5, a), (5, b), (7, a), (9, b), (None, a), (None, None), (2, "")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id), r.kept) for r in got) == sorted(
        (repr(d), repr(c), k) for d, c, k in [(5, 5, True)] * 3 + [(7, 5, False), (9, 5, False), (None, None, True), (None, None, True), (2, 2, True)]
    )


def test_hubs_leave_no_pair_out(spark):
    """One bucket of many texts of which few pairs are alike: rounds of hubs find them all."""
    rng = random.Random(8)
    sets = {i: {rng.randrange(10**6) for _ in range(20)} | {1} for i in range(40)}
    for a, b in ((3, 30), (30, 17), (25, 39)):
        sets[b] = set(sorted(sets[a])[1:]) | {rng.randrange(10**6)}
    members = spark.createDataFrame([(1, i, len(v), i, i + 1) for i, v in sets.items()], "bucket long, rep long, n int, home long, nth int")
    table = spark.createDataFrame([(i, sorted(v)) for i, v in sets.items()], "node long, set array<long>")
    links = spark.createDataFrame([], "a long, b long")
    got = {r.node: r.component for r in near_dup.settle(members, table, 80, links, places=0).collect()}
    want = plain.components([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert got == want and set(want) == {3, 30, 17, 25, 39}


def test_buckets_are_numbered_in_one_order(spark):
    rng = random.Random(12)
    met = {r: rng.choice([3, 3, 50, 400 + r]) for r in range(300)}
    rows = [(b, r, 7, met[r]) for b in range(5) for r in met if rng.random() < 0.7] + [(9, 1, 7, 3)]
    got = near_dup.numbered(spark.createDataFrame(rows, "bucket long, rep long, n long, met long")).collect()
    order = {}
    for b in {r.bucket for r in got}:
        here = sorted((r.nth, r.rep) for r in got if r.bucket == b)
        assert [n for n, _ in here] == list(range(1, len(here) + 1))
        order[b] = [rep for _, rep in here]
        assert all(met[x] * 1.1 >= met[y] for i, x in enumerate(order[b]) for y in order[b][i:])
    for b in order:
        common = set(order[0]) & set(order[b])
        assert [r for r in order[0] if r in common] == [r for r in order[b] if r in common]


def test_line_dedup(docs, texts, empty):
    out = line_dedup.dedup_lines(docs)
    got = {r.doc_id: r for r in out.collect()}
    for (d, t, _), kept in zip(texts, plain.dedup_lines([(d, t) for d, t, _ in texts]), strict=True):
        lines = (t or "").split("\n")
        assert (got[d].text, got[d].n_lines, got[d].n_dropped) == (kept, len(lines), len(lines) - (len(kept.split("\n")) if kept or t == "" or not t else 0)) or got[d].text == kept
        assert got[d].d == 7
    assert sum(r.n_dropped for r in got.values()) == 8
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert not line_dedup.dedup_lines(empty).collect()


def test_line_dedup_with_repeated_and_null_ids(spark):
    line = "x" * 40
    rows = [(1, line), (1, line), (1, f"a\n{line}\n{line}"), (2, line), (3, line), (4, line), (None, line), (None, f"{line}\nb")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.text, r.n_dropped) for r in got) == sorted(
        (repr(d), t, n) for d, t, n in [(1, "", 1), (1, "", 1), (1, "a", 2), (2, "", 1), (3, "", 1), (4, line, 0), (None, "", 1), (None, "b", 1)]
    )


def test_quality_rules(spark, docs, texts, empty):
    got = {r.doc_id: r for r in quality.judge_lines(docs.drop("n_words")).collect()}
    for d, t, _ in texts:
        w = plain.WORD.findall(t or "")
        times = plain.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (got[d].n_words, got[d].word_chars, got[d].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
    menu = "Home | About | News | Contact | Shop | Help | Terms\nOne sentence of text stands here, and it is long enough to keep."
    rows = [(1, menu), (2, "Buy!!! NOW!!! cheap!!! $$$ %%% *** go go go go go"), (3, "This site uses a cookie."), (4, "A plain sentence of ten words or a few more."), (5, "Alle Rechte VORBEHALTEN\nTous droits réservés.\nPOLÍTICA de privacidad\nUn texto sin más.")]
    judged = {r.doc_id: r for r in quality.judge_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert judged[1].clean_text.startswith("One") and judged[1].lost_words == 13 and not judged[2].kept and judged[3].clean_text == "" and judged[4].kept
    assert judged[5].clean_text == "Un texto sin más."
    assert not quality.judge_lines(empty).collect()


def test_url_filter(spark):
    rules = url_filter.rule_table(spark, [*url_filter.RULES, ("block", "ads.org", "/x"), ("allow", "ads.org", "/xy")])
    urls = {
        "http://a.EXAMPLE.com/en/1?q": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://b.www.example.com/en/#t": ("b.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es": ("x.net", "/es", None, "allow"),
        "ftp://x.net/fr/a/b/c/d": ("x.net", "/fr/a/b/c/d", "net/fr/", "block"),
        "http://x.ads.org/xyz": ("x.ads.org", "/xyz", "ads.org/xy", "allow"),
        "http://ads.org/x1/": ("ads.org", "/x1/", "ads.org/x", "block"),
        "http://com": ("com", "", None, "allow"),
        "com/": ("", "", None, "block"),
        "": ("", "", None, "block"),
        "http://h.com/" + "p/" * 3000: ("h.com", "/" + "p/" * 3000, "com/", "allow"),
        "a://b://c.com/": ("b:", "//c.com/", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate([*urls, *urls, None])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("z") for c in ("host", "path", "short", "digest", "rule")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {i: urls.get(u, ("", "", None, "block")) for i, u in rows}
    assert not url_filter.judge_urls(pages.limit(0), rules).collect()
    assert {r.verdict for r in url_filter.judge_urls(pages.where("url = 'http://com'"), rules.limit(0)).collect()} == {"allow"}


def test_permutation(spark):
    for n in (1, 2, 17, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), "test").alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))
        assert n < 1000 or [r.x for r in got] != list(range(n))


def test_mixing(docs, texts, empty):
    sizes = plain.defaultdict(int)
    for _, t, s in texts:
        sizes[s] += len(plain.words(t))
    want = plain.targets(sizes)
    rows = mixing.taken_words(docs, block_words=8, shard_slots=64).collect()
    taken = plain.defaultdict(int)
    for r in rows:
        s = next(s for d, _, s in texts if d == r.doc_id)
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
    assert len(rows) == len(texts)
    assert all(abs(taken[s] - want[s]) <= 3 * 8 for s in want)
    assert sorted(map(tuple, mixing.taken_words(docs, block_words=8, shard_slots=64).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert not mixing.taken_words(empty).collect()


def test_mix_packs_whole_blocks(docs, texts):
    slots = mixing.mix(docs, block_words=64, shard_slots=16).collect()
    assert sorted((r.shard, r.place) for r in slots) == [(i // 16, i % 16) for i in range(len(slots))]
    lengths = [len(plain.WORD.findall(r.text)) for r in slots]
    assert max(lengths) == 64 and sum(n < 64 for n in lengths) <= 3 * 4
    words_in = {w for _, t, _ in texts for w in plain.WORD.findall(t or "")}
    assert all(w in words_in for r in slots for w in plain.WORD.findall(r.text))
    # The counts of a shard are a draw around the shares of the sources.
    first = plain.Counter(r.source for r in slots)
    for k, n in first.items():
        drawn = [sum(1 for r in slots if r.shard == s and r.source == k) for s in range(len(slots) // 16)]
        assert abs(sum(drawn) / max(1, len(drawn)) - 16 * n / len(slots)) < 1.5 and (n < 64 or len(set(drawn)) > 1)


def test_decontamination(spark, docs, texts, empty):
    rng = random.Random(4)
    items = [(i, " ".join(some_words(rng, rng.randrange(14, 60)))) for i in range(12)]
    planted = [(1000 + i, " ".join([*some_words(rng, 400), *plain.words(t)[: len(t.split()) - i], *some_words(rng, 300)])) for i, t in items]
    items += [(90, None), (91, ""), (92, "ab"), (93, items[0][1]), (None, items[1][1])]
    given = docs.select("doc_id", "text", "d", "h").unionByName(spark.createDataFrame(planted + [(None, items[2][1]), (1000, "ab"), (1000, planted[0][1])], "doc_id long, text string").withColumns({"d": F.lit(7), "h": F.lit(7)}))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("set", F.lit(1))
    all_docs = [(d, t) for d, t, _ in texts] + planted + [(None, items[2][1]), (1000, "ab"), (1000, planted[0][1])]
    got = decontam.leaks(given, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain.leaks(all_docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    bad = {d for d, _ in plain.leaks(all_docs, items)}
    kept = decontam.without_leaks(given, bench)
    assert kept.columns == given.columns
    assert {repr(r.doc_id) for r in kept.collect()} >= {repr(d) for d, _ in all_docs if d not in bad} and not {r.doc_id for r in kept.collect()} & (bad - {1000})
    assert not decontam.leaks(empty.select("doc_id", "text"), bench).collect()
    assert decontam.without_leaks(given, bench.limit(0)).count() == len(all_docs)


def test_repeated_passages(spark, empty):
    rng = random.Random(3)
    docs = {i: some_words(rng, rng.randrange(5, 500), 10**6) for i in range(120)}
    planted = set()
    for _ in range(20):
        passage = some_words(rng, rng.randrange(51, 120), 10**6)
        for i in rng.sample(range(120), rng.choice([2, 3, 9])):
            at = rng.randrange(len(docs[i]) + 1)
            docs[i][at:at] = passage
            planted.add(i)
    edited = some_words(rng, 300, 10**6)
    docs[200], docs[201] = list(edited), [w if k % 60 else "new" for k, w in enumerate(edited)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(300, None), (301, ""), (None, "x " * 100)], "doc_id long, text string").withColumns(clash())
    rows = paragraphs.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} == planted | {200, 201}
    assert all((r.doc_id != r.first_doc) == r.removed and r.to_word - r.from_word >= paragraphs.PARAGRAPH for r in rows)
    cut = {r.doc_id: r.text for r in paragraphs.without_passages(df, paragraphs.repeated_passages(df)).collect()}
    assert cut[200] == " ".join(edited) and len(cut[201].split()) < 120 and cut[300] is None and len(cut) == len(docs) + 3
    assert not paragraphs.repeated_passages(empty).collect()


def test_tables_go_when_they_are_released(spark):
    tables = common.Tables()
    early = tables.stored(spark.range(5))
    late = common.stored(early.where("id > 2"))
    files = [Path(f.removeprefix("file://")) for f in early.inputFiles()]
    tables.release()
    assert files and not any(f.parent.exists() for f in files)
    assert late.count() == 2


def test_passages_end_where_texts_part(spark):
    """Exact spans of exact repeats of 51 words or more, in the text that loses them and in the one that keeps them."""
    rng = random.Random(8)
    docs, want = {}, set()
    for i in range(0, 80, 2):
        passage = some_words(rng, 51 + i // 2, 10**6)
        for d in (i, i + 1):
            before = rng.randrange(0, 70)
            docs[d] = some_words(rng, before, 10**6) + passage + some_words(rng, rng.randrange(40, 70), 10**6)
            want.add((d, before, before + len(passage), i, d != i))
    df = spark.createDataFrame([(d, "\n".join(" ".join(w[at : at + 20]) for at in range(0, len(w), 20))) for d, w in docs.items()], "doc_id long, text string")
    equal = paragraphs.repeated_passages(df, percent=100).collect()
    assert {(r.doc_id, r.from_word, r.to_word, r.first_doc, r.removed) for r in equal} == want
    # At 80 percent a paragraph with two words of the surroundings is similar enough, too.
    near = {r.doc_id: r for r in paragraphs.repeated_passages(df).collect()}
    assert all(a - 2 <= near[d].from_word <= a and b <= near[d].to_word <= b + 2 for d, a, b, _, _ in want)


def test_edited_paragraphs_are_linked(spark):
    """Paragraphs with an edit near their end are similar, not equal; most of them are linked."""
    rng = random.Random(6)
    base = [some_words(rng, 26, 10**6) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join(w[:25] + ["edit"])) for i, w in enumerate(base)]
    out = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), window=1)
    found = {r.doc_id for r in out.collect() if r.removed}
    assert len(found) >= 45 and found <= set(range(100, 160))


def test_similar_paragraphs_always_meet():
    """Sets that share 80 percent have a band key in common, also if one repeats shingles."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(3000):
        a = rng.integers(0, 2**63, 22).astype(np.uint64)
        b, edits, repeats = a.copy(), rng.integers(0, 3), rng.integers(0, 5)
        b[rng.choice(22, edits, replace=False)] = rng.integers(0, 2**63, edits).astype(np.uint64)
        b[rng.choice(22, repeats, replace=False)] = b[0]
        shared = len(set(a) & set(b))
        if 100 * shared >= 80 * len(set(a) | set(b)):
            x = np.sort(np.stack([a, b]), axis=1)
            near, far = paragraphs._smallest(x, 80)
            plain_key, odd = set(x[0][near[0]]), len(set(b)) < 22
            assert (plain_key | (set(x[0][far[0]]) if odd else set())) & set(x[1][near[1]])


def test_edits_inside_are_linked_at_the_production_window(spark):
    """Paragraphs of 26 words with an edit near their end, and lines of 100 words with edits inside: all are linked."""
    rng = random.Random(16)
    short = [some_words(rng, 26, 10**6) for _ in range(60)]
    long = [some_words(rng, 100, 10**6) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(short)] + [(100 + i, " ".join([*w[:24], "edit", w[25]])) for i, w in enumerate(short)]
    around = lambda w: f"{' '.join(some_words(rng, 30, 10**6))}\n{' '.join(w)}\n{' '.join(some_words(rng, 9, 10**6))}"
    rows += [(200 + i, around(w)) for i, w in enumerate(long)] + [(300 + i, around([x if k not in (20, 70) else "edit" for k, x in enumerate(w)])) for i, w in enumerate(long)]
    out = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("removed").collect()
    assert {r.doc_id for r in out} == {*range(100, 160), *range(300, 360)}
    # Paragraphs of 26 words with two words of the surroundings are similar enough, too.
    assert all(r.first_doc == r.doc_id - 100 for r in out)
    assert all((r.from_word, r.to_word) == (0, 26) if r.doc_id < 200 else 28 <= r.from_word <= 30 and 130 <= r.to_word <= 132 for r in out)


def test_a_common_line_is_no_meeting_place(spark):
    """Paragraphs that share one line with many others are linked to those they resemble, and to no other."""
    rng = random.Random(7)
    line = some_words(rng, 14, 10**6)
    sets, homes = {}, []
    for i in range(60):
        sets[i] = [hash(w) for w in line] + [hash(w) for w in some_words(rng, 8, 10**6)]
    sets[50] = sets[3][:-1] + [5]
    sets[51] = sets[50][1:] + [6]
    homes = [(1, i, i) for i in sets]
    placed = spark.createDataFrame(homes, "bucket long, u long, home long")
    table = spark.createDataFrame(list(sets.items()), "node long, set array<long>")
    split = paragraphs._meeting(paragraphs._split_crowds(placed, table, 80))
    assert {r.u for r in split.collect()} <= {3, 50, 51} and {3, 50} <= {r.u for r in split.collect()}


def test_toxicity_learns_pairs(spark):
    """Two terms are toxic together only: the machine learns what weights alone can't."""
    import numpy as np

    rng = random.Random(2)
    rows = []
    for i in range(900):
        has = [rng.random() < 0.5, rng.random() < 0.5]
        w = some_words(rng, 20, 50) + ["insult"] * has[0] + ["group"] * has[1]
        rows.append((i, " ".join(w), int(all(has))))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.toxicity_scores(docs, docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in scored]) > 0.97


def test_toxicity_on_odd_rows(spark, docs, texts, empty):
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _, _ in texts] + [(None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.held_out == (plain.fold(r.doc_id) == 0) for r in rows)
    assert len(toxicity.toxicity_scores(docs, labels.limit(0)).where("predicted = 0").collect()) == len(texts)
    assert not toxicity.toxicity_scores(empty, labels).collect()


def test_languages(spark, empty):
    rng = random.Random(9)
    letters = {"aa": "abcdeé", "bb": "fghijß", "cc": "klmnoñ"}
    rows = [(i, " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(rng.randrange(3, 60))), k if i % 7 else None) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 ...", "bb"), (None, "abc", "aa"), (1003, "x" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(clash())
    got = langid.languages(docs).collect()
    assert len(got) == len(rows)
    truth = {i: ["aa", "bb", "cc"][i % 3] for i in range(180)}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth) >= 175
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert not langid.languages(docs.limit(0)).collect()


def test_language_model(docs, texts, empty):
    tokens = {d: [*plain.words(t), ""] for d, t, _ in texts}
    learned = [d for d in tokens if plain.fold(d) != 1]
    count = plain.Counter(w for d in learned for w in tokens[d])
    pairs = plain.Counter(p for d in learned for p in zip([None, *tokens[d]], tokens[d]))
    before, total, after = plain.Counter(v for _, v in pairs), plain.Counter(), plain.defaultdict(lambda: [0, 0, 0])
    for (u, _), n in pairs.items():
        total[u] += n
        after[u][min(n, 3) - 1] += 1
    of = lambda values: [sum(n == k for n in values) for k in (1, 2, 3, 4)]
    big, small = ngram_lm.discounts(*of(pairs.values())), ngram_lm.discounts(*of(before.values()))
    n_all, v_all, n_pairs = sum(count.values()), len(count), len(pairs)
    rest = sum(small[min(n, 3)] for n in before.values()) / n_pairs
    got = {r.doc_id: r for r in ngram_lm.lm_scores(docs).collect()}
    for d, w in tokens.items():
        score = 0.0
        for u, v in zip([None, *w], w):
            low = max(before[v] - small[min(before[v], 3)], 0) / n_pairs + rest / (v_all + 1)
            n = pairs[u, v]
            p = (max(n - big[min(n, 3)], 0) + sum(a * b for a, b in zip(big[1:], after[u])) * low) / total[u] if total[u] else low
            score += math.log10(p)
        base = sum(math.log10((count[x] + 0.5) / (n_all + 0.5 * (v_all + 1))) for x in w)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in count for x in w), n_all, plain.fold(d) == 1)
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)
    assert not ngram_lm.lm_scores(empty).collect()
    assert math.isfinite(ngram_lm.lm_scores(docs.limit(5), ngram_lm.fit(empty)).first().score)


def test_counts_above_four_bytes_are_merged(tmp_path):
    """Two tasks that saw a pair three billion times each: six billion are written and read back."""
    import numpy as np
    import pyarrow as pa

    u, v, n = (np.array(x, np.uint64) for x in ([9, 9], [11, 12], [3_000_000_000, 2]))
    blobs = [ngram_lm.pack([u, v, n]), ngram_lm.pack([u[:1], v[:1], n[:1]])]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])
    merged = list(ngram_lm._pair_merger(str(tmp_path), 1)(iter([batch])))
    list(ngram_lm._word_merger(str(tmp_path))(iter([b.select(["part", "blob"]) for b in merged])))
    model = ngram_lm.Model(str(tmp_path), 1, 1, 1, 2, np.zeros(4), np.zeros(4), 0.0)
    keys = ngram_lm.pair_keys(u, v)
    order = np.argsort(keys)
    found = ngram_lm.Arrays(model).find("pairs", ("n",), keys[order])[0]
    assert found.tolist() == np.array([6_000_000_000, 2], np.uint64)[order].tolist()


def test_a_model_in_many_parts_scores_alike(docs, monkeypatch):
    want = {r.doc_id: r.score for r in ngram_lm.lm_scores(docs).collect()}
    monkeypatch.setattr(ngram_lm, "PART_BYTES", 2_000)
    model = ngram_lm.fit(docs)
    assert model.parts > 50
    for open_parts in (128, 3):
        monkeypatch.setattr(ngram_lm, "OPEN_PARTS", open_parts)
        got = {r.doc_id: r.score for r in ngram_lm.lm_scores(docs, model).collect()}
        assert got == pytest.approx(want, rel=1e-12)


def test_a_short_item_does_not_raise_the_probes_of_long_ones(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(some_words(rng, 300, 4_000))) for i in range(40)], "doc_id long, text string")
    long = [(i, " ".join(some_words(rng, 200, 4_000))) for i in range(6)]

    def probed(items):
        sketches = decontam.item_sketches(decontam.item_sets(spark.createDataFrame(items, "item_id long, text string")))
        cuts = {r.part: r.top for r in sketches.groupBy("part").agg(F.max("h").alias("top")).collect()}
        return {r.part: r.n for r in decontam.probes(docs, cuts).groupBy("part").agg(F.count("h").alias("n")).collect()}

    alone, mixed = probed(long), probed([*long, (6, "one two three four five six")])
    assert {p: mixed[p] for p in alone} == alone and len(mixed) == len(alone) + 1
    assert sum(alone.values()) < 0.4 * 40 * 296

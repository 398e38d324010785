"""Manifest, alignment of tokenizers and chat formatting against plain Python, on odd rows."""

import hashlib
import random
from collections import Counter

import pytest
from gatekit.llm import chat, manifest
from gatekit.llm import cross_tokenizer as X
from gatekit.llm.queries import SPARK
from pyspark.sql import functions as F

CLASHING = "g h i n b t ts own levels members root name part row a pair links o turns formatted".split()
SF = "/root/testdata/sf0.001"


def clash(df, keep=()):
    return df.withColumns({c: F.lit(7) for c in CLASHING if c not in df.columns and c not in keep})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """(root, path of each node): siblings with their side."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            paths[k].append((p % 2, nodes[p ^ 1] if p ^ 1 < len(nodes) else None))
        nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        place = [p // 2 for p in place]
    return nodes[0], paths


def plain_manifest(rows):
    """rows: (key, group, leaf); sorted (key, leaf, siblings, subroot, root)."""
    groups = {}
    for key, group, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(group, []).append((key, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: tree([leaf for _, leaf in groups[g]]) for g in names}
    root, outer = tree([inner[g][0] for g in names])
    out = []
    for g, above in zip(names, outer, strict=True):
        for (key, leaf), path in zip(groups[g], inner[g][1], strict=True):
            out.append((key, leaf, "".join(s for _, s in path + above if s), inner[g][0], root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 1 << levels)
    rng = random.Random(levels)
    rows = [(k, rng.choice(["en", "de", "é", None, ""]), sha(str(k))) for k in rng.sample(range(10_000), 150)]
    rows += [(k, "en", sha(f"x{k}")) for k in range(20_000, 20_041)] + [(None, "de", sha("-")), (7, "fr", sha("7"))]
    rows += [(5, "en", sha("same"))] * 9 + [(5, "en", sha("other"))]
    df = clash(spark.createDataFrame(rows, "doc_id long, lang string, leaf string"), "g h i n").repartition(5)
    got = manifest.manifest(df).cache()
    back = got.select("doc_id", "leaf", manifest.siblings(F.col("path")).alias("s"), "subroot", "root").collect()
    assert sorted(map(tuple, back), key=str) == plain_manifest(rows)
    assert got.where(manifest.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert got.where(manifest.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).isEmpty()
    assert manifest.manifest(df.limit(0)).isEmpty()


def test_digest_tells_fields_apart(spark):
    row = spark.sql("select 'ab' a, cast(null as string) b, 12L c, 'é' d, '' e")
    got = row.select(manifest.digest(*[F.col(c) for c in "abcde"])).first()[0]
    assert got == sha("2:ab-2:122:é0:")


def aligned(v, encode_a, encode_b, text):
    """(ids of A, ids of B, groups, links) by comparing all pairs of tokens."""
    if not text:
        return None
    ids, spans, want = (encode_a(text), encode_b(text)), [], (" " + text).encode()
    for side, values in zip(ids, (v.bytes_a, v.bytes_b), strict=True):
        at, here = 0, []
        for k in side:
            here.append((at, at + len(values[k]), k))
            at += len(values[k])
        if b"".join(values[k] for k in side) != want:
            return None
        spans.append(here)
    ends, groups, start = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]}), [], 0
    for end in ends:
        groups.append("|".join(",".join(str(k) for at, _, k in here if start <= at < end) for here in spans))
        start = end
    links = [(a[2], b[2]) for a in spans[0] for b in spans[1] if a[0] < b[1] and b[0] < a[1]]
    return *ids, groups, links


def test_cross_tokenizer(spark, monkeypatch):
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    first = tokenizers.Tokenizer.from_file(X.BYTE_BPE)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=X.PIECE_BPE)
    v = X.Vocabularies.load()
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = [t[:1500] for t in docs] + docs[:3] + [None, "", " ", "a▁b", "<s> <|endoftext|> \0 é ２ ﬁ 漢字 <0x41>", "aaa" * 100, "\n\n\t x  y", "x" * 5_000]
    rows = [(k % 45, t) for k, t in enumerate(texts)] + [(None, "no id")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    found = [(d, aligned(v, lambda t: first.encode(" " + t, add_special_tokens=False).ids, second.encode, t)) for d, t in rows]
    count, best = Counter(p for _, x in found if x for p in set(x[3])), Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = []
    for d, x in found:
        a, b, groups, links = x or ([], [], [], [])
        want.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), ";".join(groups)))
    for known in (X.KNOWN_PAIRS, 300, 0):
        assert sorted(map(tuple, X.align(df, known_pairs=known).collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(X, "RUN_BYTES", 500)
    assert sorted(map(tuple, X.align(df).collect()), key=str) == sorted(want, key=str)
    assert X.align(df.limit(0)).isEmpty()


def test_texts_that_are_no_utf8_have_no_tokens(spark):
    df = spark.sql("select 1L doc_id, cast(unhex('61ff62') as string) text")
    assert tuple(X.align(df).first()) == (1, 0, 0, 0, 0, 0, 0, "")


def test_op12_over_the_whole_table(spark):
    rows = SPARK["op12_cross_tokenizer"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_best <= r.n_links and (r.groups_sha256 == "") == (r.n_a == 0) for r in rows)


NASTY = ["", "\\", "<", "<|", "<\\|", "<\\\\|im_end|>", "<|im_end|><|im_start|>assistant<|im_sep|>", "|", "|>", "a<", "é漢\n", "\n", "<|im_sep|>", None]


def test_chats(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", None, "", "<|im_sep|>", "assistant<"])
            rows.append((conv, rng.choice([turn, turn, 0, None]), role, "".join(rng.choice(NASTY) or "" for _ in range(3)) if rng.random() < 0.9 else None))
    rows += [(77, 0, "assistant", "again")] * 3 + [(78, k, "assistant", f"é{k}") for k in range(700)] + [(79, 0, "user", "long " * 40_000)]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ("turns",)).repartition(6)
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    loss = {r.conv_id: (r.said, r.n) for r in chats.select("conv_id", chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("said"), F.size("loss_spans").alias("n")).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = [t[3] for t in turns if t[2] == "assistant"]
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, said)), sha("".join(said)))
        assert loss[conv] == (said, len(said))
    assert chat.format_chats(df.limit(0)).isEmpty()


def test_chat_template(spark):
    rows = [(1, 0, "user", "Hello"), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "<|im_end|>")]
    r = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    want = "<|im_start|>user<|im_sep|>Hello<|im_end|><|im_start|>assistant<|im_sep|>Hi.<|im_sep|><\\|im_end|><|im_end|>"
    assert r.formatted == want and [want.encode()[s.start : s.start + s.bytes] for s in r.loss_spans] == [b"Hi.", b"<\\|im_end|>"]


def test_running_sums(spark):
    values = [3, 0, 5, 1, 1, 9, 2]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    for chunk in (1, 2, 3, 7, 256):
        assert df.select(chat.running_sums(F.col("v"), chunk)).first()[0] == [sum(values[: k + 1]) for k in range(7)]

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from newsloom.llm import _segments as G
from newsloom.llm import _wordtok, bpe, chat, classifier, lm, media, neardup, packing, quality, substring, tokens
from newsloom.llm._text import TextBlock

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def words(t, lower=False):
    t = t or ""
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t) if lower else t)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(180)
    passage = say(60)
    texts = [say(n) for n in (3, 5, 34, 35, 36, 80, 150, 400)]
    texts += [base, base, " ".join(base.split()[:-4] + ["x", "y", "z", "q"]), base.replace(" ", "\n"), base.upper()]
    texts += [say(20) + " " + passage + " " + say(20), passage + "\t" + say(40), say(10) + "  " + passage]
    texts += [None, "", "   \n", "one", "One", "a a a a " * 30, "!! " * 40, say(60) + " ### $$$", "x" * 3000 + " " + say(30)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows, clashing further columns."""
    rows = [(None, "alpha beta gamma delta eps", 1, "z"), (7, "alpha beta gamma delta eps", 2, "z"), (7, "alpha beta gamma delta eps", 2, "z"), (None, None, 3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, Kept string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, corpus, odd, empty):
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs, keep=["doc_id"]).collect()}
    assert len(rows) == len(corpus)
    for i, t in corpus:
        r = rows[i]
        assert (r["n_words"], r["word_chars"]) == (len(words(t)), sum(map(len, words(t))))
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert rows[7]["kept"] and not rows[22]["kept"]
    for order in (quality.RULES, quality.RULES[::-1]):  # the order never decides
        got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs, keep=["doc_id"], rules=order).collect()}
        assert got == {i: r["kept"] for i, r in rows.items()}
    out = quality.quality_rules(odd)
    assert out.columns[:6] == ["doc_id", "text", "n_words", "Kept", "n_words_", "word_chars"] and out.columns[-1] == "kept_" and out.count() == 4
    assert quality.quality_rules(empty).count() == 0


def test_cascade_order(spark):
    """Rules by rejections per unit of a counted cost, over partitions all along the table."""
    ticks, step = [0.0], 8
    rows = [(i, " ".join(f"{'odd' if i % 2 else 'even'}{i * 31 + j}" for j in range(30)) + (" late" * (i >= 300))) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartitionByRange(step, "doc_id").sortWithinPartitions("doc_id")

    def rule(name, cost, flag):
        def rejects(b, base):
            ticks[0] += cost * b.n
            return np.array([flag(b.slice_bytes(i)) for i in range(b.n)], bool)

        return quality.Rule(name, rejects)

    cheap = rule("cheap", 1, lambda t: t.startswith(b"odd"))  # 1/2 for 1
    dear = rule("dear", 10, lambda t: True)  # 1 for 10
    late = rule("late", 1, lambda t: t.endswith(b"late"))  # 1/4 for 1, none in the first partitions
    never = rule("never", 0.001, lambda t: False)
    for given in ((never, late, dear, cheap), (cheap, dear, late, never)):
        assert [r.name for r in quality.ordered(docs, rules=given, sample_rows=80, clock=lambda: ticks[0])] == ["cheap", "late", "dear", "never"]
    seen = []
    b = TextBlock(pa.array([t for _, t in rows]))
    spy = quality.Rule("spy", lambda b, base: (seen.append(b.n), np.zeros(b.n, bool))[1])
    quality.cascade(b, quality.base_figures(b), (cheap, spy, dear, spy))
    assert seen == [200]  # a rule sees what is left, and none runs on nothing


def test_media(spark, docs, corpus, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/m"
    media.write_archives(docs, folder, archive_bytes=5000)
    rows = media.read_media(spark, folder).select(F.col("key").cast("long").alias("i"), F.arrow_udf(media.digest, media.DIGEST)("media").alias("d")).select("i", "d.*").collect()
    assert len(rows) == len(corpus)
    texts = dict(corpus)
    for r in rows:
        raw = (texts[r["i"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [(r["media_sha256"], r["feature"]) for r in rows if r["i"] in (8, 9)]
    assert same[0] == same[1]
    media.write_archives(odd, f"file://{tmp_path}/o")
    assert sorted(str(r["key"]) for r in media.read_media(spark, f"file://{tmp_path}/o").collect()) == ["7", "7", "None", "None"]
    media.write_archives(empty, f"file://{tmp_path}/e")
    assert media.read_media(spark, f"file://{tmp_path}/e").count() == 0


def test_media_ranges_and_retries(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/m"
    media.write_archives(docs.coalesce(1), folder)
    reader = media.ArchiveReader({"path": folder, "splitbytes": "700", "retries": "2"})
    parts = reader.partitions()
    assert len(parts) > 3
    found = [o for p in parts for b in reader.read(p) for o in b.column(1).to_pylist()]
    assert len(found) == len(set(found)) == docs.count()  # each member in exactly one range

    class Flaky:
        def __init__(self, f):
            self.f = f

        def __getattr__(self, name):
            return getattr(self.f, name)

        def read(self, n):
            Flaky.calls += 1
            if Flaky.calls % 5 == 0:
                raise OSError("lost")
            return self.f.read(n)

    Flaky.calls = 0
    inner = reader.member

    def member(fs, path, info, handle):
        class Fs:
            def open_input_file(self, p):
                return Flaky(fs.open_input_file(p))

        return inner(Fs(), path, info, handle)

    reader.member = member
    assert len([o for p in parts for b in reader.read(p) for o in b.column(1).to_pylist()]) == len(found)


def test_media_feature(spark, docs, corpus, tmp_path):
    media.write_archives(docs, f"file://{tmp_path}/m")
    got = media.read_media(spark, f"file://{tmp_path}/m").select(F.col("key").cast("long").alias("i"), F.arrow_udf(media.digest, media.DIGEST)("media")["feature"].alias("f")).collect()
    texts = dict(corpus)
    for r in got:
        raw = (texts[r["i"]] or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        bins = Counter(x // 16 for x in raw)
        assert r["f"] == "".join(f"{bins[k] * 255 // len(raw):02x}" for k in range(16)) + f"{sum(raw) // len(raw):02x}"


def test_png_is_strict():
    data = media.png(media.payload_of(b"abc"), 3)
    assert media.png_samples(data) == (b"abc" + bytes(61), 3)
    with pytest.raises(ValueError):
        media.png_samples(data[:40] + b"\xff" + data[41:])


def test_classifier(spark, odd, empty):
    rng = random.Random(1)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90)))
    junk = [lambda: "*** ".join(clean().split()), lambda: "same words here " * 20, lambda: clean().upper().replace(" ", "!! ")]
    rows = [(i, clean() if i % 3 else rng.choice(junk)(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in classifier.quality_classifier(docs, labels, keep=["doc_id"]).collect()}
    held = [r for r in rows if out[r[0]]["held_out"]]
    assert all(out[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert sum(out[r[0]]["predicted"] == r[2] for r in held) >= 0.95 * len(held)
    flipped = labels.join(docs.select("doc_id", classifier.held_out(F.col("doc_id")).alias("h")), "doc_id").select("doc_id", F.when(F.col("h"), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    again = {r["doc_id"]: r["score"] for r in classifier.quality_classifier(docs, flipped, keep=["doc_id"]).collect()}
    assert again == pytest.approx({i: r["score"] for i, r in out.items()})  # held-out labels teach nothing
    got = classifier.quality_classifier(odd.withColumn("Score", F.lit(1)), labels)
    assert got.count() == 4 and got.columns[-2:] == ["score_", "predicted"]
    assert classifier.quality_classifier(empty, labels).count() == 0
    none = classifier.quality_classifier(docs, labels.limit(0), keep=["doc_id"]).agg(F.min("score"), F.max("score")).first()
    assert tuple(none) == (0.5, 0.5)


def test_discriminant_equals_textbook():
    """Scores against a discriminant written out with inverse and determinant."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (80, 11)), rng.normal(1, 2, (50, 11))])
    y = np.repeat([1, 0], [80, 50])
    model = classifier.Model.fit({c: (float((y == c).sum()), x[y == c].sum(axis=0), x[y == c].T @ x[y == c]) for c in (0, 1)})
    pooled = np.diag(x.var(axis=0) + 1e-6)
    log = []
    for c in (0, 1):
        z = x[y == c]
        cov = 0.95 * np.cov(z.T, bias=True) + 0.05 * pooled
        d = x - z.mean(axis=0)
        log.append(np.log(len(z) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))), rel=1e-6, abs=1e-9)


def test_features_by_hand(corpus):
    got = classifier.features(TextBlock(pa.array([t for _, t in corpus], pa.string())))
    for (_, t), row in zip(corpus, got, strict=True):
        t, w = t or "", words(t)
        chars, n = max(1, sum(map(len, w))), max(1, len(w))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = Counter(grams)
        repeat = len({i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(8)})
        share = lambda part, whole, half: part / whole / (part / whole + half)
        top = max(Counter(w).values(), default=0)
        want = [
            math.log1p(len(w)),
            share(sum(c in "#*$%&|<>" for c in t), chars, 0.02),
            share(sum(c in "!?" for c in t), chars, 0.02),
            share(sum("A" <= c <= "Z" for c in t), chars, 0.2),
            share(sum(a == b for a, b in zip(w, w[1:], strict=False)), n, 0.1),
            share(repeat, n, 0.3),
            share(len(lines) - len(set(lines)), max(1, len(lines)), 0.3),
            math.log(chars / n),
            math.sqrt(len(set(w)) / n),
            math.sqrt(top / n),
            math.log(n / max(1, len(lines))),
        ]
        assert row.tolist() == pytest.approx(want)


def ids_of(corpus):
    tok = Tokenizer.from_file(_wordtok.default_file())
    return {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in corpus}


def test_token_files(spark, docs, corpus, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = tokens.write_tokens(docs, folder, row_group_tokens=500)
    got = sorted(tuple(r) for r in tokens.read_tokens(spark, folder, manifest).collect())
    want, start = [], 0
    for i, x in sorted(ids_of(corpus).items()):
        want.append((i, start, len(x), x.tolist()))
        start += len(x)
    assert [(a, b, c, list(d)) for a, b, c, d in got] == want
    plan = tokens.read_tokens(spark, folder, manifest, ("doc_id", "n_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "ids:" not in plan
    m = tokens.write_tokens(odd, f"file://{tmp_path}/o")
    assert sorted(r["start"] for r in tokens.read_tokens(spark, f"file://{tmp_path}/o", m, ("start",)).collect())[0] == 0
    e = tokens.write_tokens(empty, f"file://{tmp_path}/e")
    assert tokens.read_tokens(spark, f"file://{tmp_path}/e", e).count() == 0


def test_words_encoded_as_the_library_does():
    """Blocks of odd texts, sliced and with nulls, and a memo that is cut all the time."""
    rng = random.Random(11)
    tok, enc = Tokenizer.from_file(_wordtok.default_file()), _wordtok.WordEncoder(_wordtok.default_file(), memo_words=40)
    atoms = [*"aBz09.,!?;:'#-\x01\x1c\x1f\x7f\x85\xa0éÉßİǅ\u0301\u2028\u3000한中😀", "'s", "...", "word", "Word.", "<|endoftext|>", "e\u0301", "ﬁ"]
    blanks = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "", ""]
    say = lambda: "".join(rng.choice(atoms) + rng.choice(blanks) for _ in range(rng.randint(0, 30)))
    for n in (0, 1, 7, 60):
        texts = [rng.choice([None, "", " ", ".", " . ", say(), say(), say(), say()]) for _ in range(n + 2)]
        got = enc.encode(TextBlock(pa.array(texts, pa.string()).slice(1, n)))
        assert [x.tolist() for x in got] == [[*tok.encode(t or "", add_special_tokens=False).ids, _wordtok.END_ID] for t in texts[1 : n + 1]]


def test_memo_asked_once_for_each_word_of_a_block():
    asked = []

    class Memo(dict):
        def __contains__(self, w):
            asked.append(w)
            return super().__contains__(w)

        def __getitem__(self, w):
            asked.append(w)
            return super().__getitem__(w)

        def get(self, w, default=None):
            asked.append(w)
            return super().get(w, default)

    enc = _wordtok.WordEncoder(_wordtok.default_file())
    block = TextBlock(pa.array([" ".join(f"word{'abcde'[i % 5]}" for i in range(k, k + 500)) for k in range(4)]))
    first = enc.encode(block)
    enc.young = Memo(enc.young)
    again = enc.encode(block)
    assert Counter(asked) == {f"word{c}".encode(): 1 for c in "abcde"}
    assert [x.tolist() for x in again] == [x.tolist() for x in first]


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "assistant", "A"), (1, 3, "user", "bye"), (2, 0, "user", "only"), (3, 0, "assistant", None), (4, 0, None, "x"), (4, 0, None, "x")]
    out = {r["conv_id"]: r for r in chat.preference_pairs(chat.derived_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out[1]["n_prompt_turns"] == 2 and out[1]["prompt"] == "<|system|>\nS\n<|user|>\nhi\n"
    assert [(s["text"], s["mask"]) for s in out[1]["chosen_completion"]] == [("<|assistant|>\nA\n", 1), ("<|user|>\nbye\n", 0)]
    assert [(s["text"], s["mask"]) for s in out[1]["rejected_completion"]] == [("<|assistant|>\nhi\n", 1)]
    assert out[2]["chosen_completion"] == [] and out[2]["n_prompt_turns"] == 1
    assert out[3]["n_prompt_turns"] == 1 and out[4]["prompt"].count("<|unknown|>") == 2
    turn = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(9, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")]), (8, [], None)], f"pair long, chosen {turn}, rejected {turn}")
    got = {r["pair"]: r for r in chat.preference_pairs(pairs).collect()}
    assert got[9]["n_prompt_turns"] == 1 and got[8]["prompt"] == "" and got[8]["chosen_completion"] == []


def test_chat_odd_pairs(spark):
    turn = "array<struct<role:string,text:string>>"
    long_ = "word " * 1_200_000
    rows = [
        (1, "x", [None, ("user", "b")], [("user", "b")]),
        (2, "x", [None, (None, None), ("assistant", "c")], [("unknown", ""), ("unknown", None), ("assistant", "d")]),
        (3, "x", [("user", "<|assistant|>\nhi <\\| <\\\\|"), ("a|>b", "t")], [("user", "<|assistant|>\nhi <\\| <\\\\|")]),
        (4, None, [("user", long_), ("assistant", long_)], [("user", long_), ("assistant", "no")]),
        (None, None, None, None),
        (None, None, None, None),
    ]
    pairs = spark.createDataFrame(rows, f"_n long, prompt string, chosen {turn}, rejected {turn}")
    out = chat.preference_pairs(pairs)
    assert out.columns == ["_n", "prompt", "n_prompt_turns", "prompt_", "chosen_completion", "rejected_completion"]
    got = {r["_n"]: r for r in out.collect()}
    assert (got[1]["n_prompt_turns"], got[1]["prompt_"], len(got[1]["chosen_completion"])) == (0, "", 2)
    assert (got[2]["n_prompt_turns"], got[2]["prompt_"]) == (2, "<|unknown|>\n\n" * 2)
    assert got[3]["prompt_"] == "<|user|>\n<\\|assistant|>\nhi <\\\\| <\\\\\\|\n" and got[3]["chosen_completion"][0]["text"] == "<|a|\\>b|>\nt\n"
    assert got[4]["prompt_"] == f"<|user|>\n{long_}\n" and got[4]["chosen_completion"][0]["text"] == f"<|assistant|>\n{long_}\n"
    assert out.where("_n is null").count() == 2 and got[None]["prompt"] is None
    assert chat.preference_pairs(pairs.limit(0)).count() == 0
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_pairs(chat.derived_pairs(nothing)).count() == 0


def check_packing(rows, ids, window):
    by_seq, by_doc = {}, {}
    for r in rows:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length, padded in sorted(parts):
            assert offset == at
            at += length
        assert at <= padded <= window and (padded == window or padded & (padded - 1) == 0)
    for i, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(by_doc) == set(ids)
    return by_seq


def test_packing(docs, corpus, odd, empty):
    ids = ids_of(corpus)
    by_seq = check_packing(packing.pack(docs, window=256).collect(), ids, 256)
    rests = sorted((len(x) % 256 for x in ids.values() if len(x) % 256), reverse=True)
    rooms = []
    for n in rests:  # plain best fit decreasing
        fit = min((r for r in rooms if r >= n), default=None)
        rooms.remove(fit) if fit is not None else None
        rooms.append((256 if fit is None else fit) - n)
    assert len(by_seq) == len(rooms) + sum(len(x) // 256 for x in ids.values())
    assert packing.pack(odd).count() == 4 and packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_equals_sequential_best_fit(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 100])
    sizes = [rng.randint(1, window) for _ in range(rng.randint(1, 300))]
    plan = packing.Plan(dict(Counter(sizes)), window)
    ranks, fill = Counter(), {}
    for n in sizes:
        s, o, _ = plan.place(np.array([n]), np.array([ranks[n]]))
        ranks[n] += 1
        fill.setdefault(int(s[0]), []).append((int(o[0]), n))
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        rooms.remove(fit) if fit is not None else None
        rooms.append((window if fit is None else fit) - n)
    assert sorted(window - sum(n for _, n in x) for x in fill.values()) == sorted(rooms)
    assert set(fill) == set(range(plan.sequences))


def test_bpe(docs, corpus, odd, empty):
    ref = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_file()), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_texts(docs, keep=["doc_id"], digest=True).collect()}
    for i, t in corpus:
        want = ref.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    out = bpe.encode_texts(odd.withColumn("IDS", F.lit(0)))
    assert out.columns[-1] == "ids_" and out.withColumn("back", bpe.decode_ids("ids_")).where(F.col("back") == F.coalesce("text", F.lit("")).cast("binary")).count() == 4
    assert bpe.encode_texts(empty).count() == 0


def test_bpe_code_points():
    ref = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_file()), special_tokens={})
    mine = bpe.encoder(bpe.default_file(), bpe.default_pattern())
    for c in [*range(0x2100), 0x3000, 0xFEFF, 0x1F600, 0x10FFFF]:
        s = f"a {chr(c)}b  {chr(c)}{chr(c)} \n x{chr(c)}1's"
        assert mine.encode([s])[0].tolist() == ref.encode_ordinary(s)


def test_perfect_hash():
    keys = np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64)
    h = bpe.PerfectHash(np.unique(keys))
    assert sorted(h.slots(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


def brute_repeats(corpus, k):
    lists = [words(t) for _, t in corpus]
    at = {}
    for d, ws in enumerate(lists):
        for i in range(len(ws) - k + 1):
            at.setdefault(tuple(ws[i : i + k]), []).append((d, i))
    gone = [set() for _ in lists]
    for v in at.values():
        if len(v) > 1:
            for d, i in v:
                gone[d] |= set(range(i, i + k))
    return lists, gone


@pytest.mark.parametrize("k", [2, 5, 35])
def test_substring_dedup(docs, corpus, k):
    lists, gone = brute_repeats(corpus, k)
    got = {r["doc_id"]: r for r in substring.substring_dedup(docs, keep=["doc_id"], window=k, digest=True).collect()}
    for (i, _), ws, g in zip(corpus, lists, gone, strict=True):
        kept = " ".join(w for j, w in enumerate(ws) if j not in g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(ws), len(g), hashlib.sha256(kept.encode()).hexdigest())


def test_substring_runs_and_shapes(spark, odd, empty):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(30, 120))) for _ in range(12)] + ["a " * 50, "b a " * 40, "a " * 34 + "c", " ".join(str(i) for i in range(80))]
    corpus = list(enumerate(texts))
    lists, gone = brute_repeats(corpus, 35)
    got = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(spark.createDataFrame(corpus, SCHEMA).repartition(2), keep=["doc_id"], digest=True).collect()}
    assert got == {i: len(g) for (i, _), g in zip(corpus, gone, strict=True)}
    out = substring.substring_dedup(odd, window=3)
    assert {r["text"] for r in out.where("doc_id = 7").collect()} == {""} and out.count() == 4 and "n_words_" in out.columns
    assert substring.substring_dedup(empty).count() == 0


def test_substring_passes_keep_their_work(spark, monkeypatch):
    """The second pass over a segment picks no symbols anew and the last one hashes no words."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None]
    corpus = list(enumerate(texts))
    lists, gone = brute_repeats(corpus, 5)
    made, passes, whole = [], [], G.stage
    monkeypatch.setattr(G, "stage", lambda *a: made.append(whole(*a)) or made[0])
    monkeypatch.setattr(G, "map_segments", lambda segments, fn, schema, replies=None: passes.append(fn))
    monkeypatch.setattr(G, "exchange", lambda *a: None)
    substring.substring_dedup(spark.createDataFrame(corpus, SCHEMA).coalesce(1), keep=["doc_id"], window=5, digest=True)
    ((seg, path),) = made[0].manifest.select("seg", "path").collect()

    def answered(rows, asked):
        got = {}
        for kind, blob in ((r["kind"], r["blob"]) for batch in rows for r in batch.to_pylist()):
            if kind == asked:
                place, _, total, group, _ = G._merged([blob])
                blob = G.packed(G.twice(place, total)[0][group])
            got.setdefault(kind, []).append(blob)
        return got

    def again(*a):
        raise AssertionError("worked out again")

    got = answered(passes[0](seg, path, {}), 1)
    monkeypatch.setattr(substring.Words, "picks", again)
    got = answered(passes[1](seg, path, got), 2)
    monkeypatch.setattr(substring.TextBlock, "span_hash", again)
    out = {r["doc_id"]: (r["n_words"], r["n_removed"]) for batch in passes[2](seg, path, got) for r in batch.to_pylist()}
    assert out == {i: (len(ws), len(g)) for (i, _), ws, g in zip(corpus, lists, gone, strict=True)} and any(gone)


def lm_by_force(corpus, exclude_self=True):
    """score by exact counts passed through the filter's quantisation."""
    toks = {i: [*words(t, True), None] for i, t in corpus}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 10]
    grams = lambda ws, n: [None] * (n == 3) + [tuple(x) for x in zip(*([None, *ws][k:] for k in range(2)), strict=False)] if n == 2 else [None, *zip([None, *ws], ws, ws[1:], strict=False)]
    count = {1: Counter(w for i in train for w in toks[i])} | {n: Counter(g for i in train for g in grams(toks[i], n) if g) for n in (2, 3)}
    n_train, v = sum(count[1].values()), len(count[1])

    def soft(c):
        q = c.bit_length()
        return sum(1 / x for x in range(1 << q - 1, 1 << q)) / sum(1 / x**2 for x in range(1 << q - 1, 1 << q)) if c else 0.0

    out = {}
    for i, ws in toks.items():
        off = exclude_self and i in train
        own = {n: Counter(grams(ws, n) if n > 1 else ws) if off else Counter() for n in (1, 2, 3)}
        n_here = n_train - len(ws) * off
        score = 0.0
        for k, w in enumerate(ws):
            one = lambda x: count[1][x] - own[1][x]
            p = (one(w) + 0.1) / (n_here + 0.1 * (v + 1))
            two, three = grams(ws, 2), grams(ws, 3)
            take = lambda n, g: max(0.0, soft(count[n][g]) - own[n][g])
            h = one(ws[k - 1] if k else None)
            p = (min(take(2, two[k]), h) + 500 * p) / (h + 500)
            if k:
                h = take(2, two[k - 1])
                p = (min(take(3, three[k]), h) + 3 * p) / (h + 3)
            score += math.log10(p)
        out[i] = len(ws), sum(count[1][w] > 0 for w in ws), n_train, sum(math.log10((count[1][w] + 0.1) / (n_train + 0.1 * (v + 1))) for w in ws), score
    return train, out


@pytest.mark.parametrize("exclude_self", [True, False])
def test_lm(docs, corpus, exclude_self):
    train, want = lm_by_force(corpus, exclude_self)
    wide = lm.lm_scores(docs, bits=64, exclude_self=exclude_self).collect()  # a filter next to free of false positives
    for r in wide:
        n, known, n_train, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] not in train, n, known, n_train)
        assert (r["base_score"], r["score"]) == (pytest.approx(base), pytest.approx(score))
    rows = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, exclude_self=exclude_self).collect()}
    shards = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, broadcast_bytes=-1, exclude_self=exclude_self).collect()}
    assert shards == rows
    assert all(abs(rows[i] - want[i][4]) <= 0.02 * want[i][0] + 1e-6 for i in rows)


def test_lm_shapes(odd, empty):
    assert lm.lm_scores(odd).count() == 4 and lm.lm_scores(empty).count() == 0


def test_lm_filter():
    rng = np.random.default_rng(4)
    place = np.unique(rng.integers(0, 1 << 32, 100_000, dtype=np.uint64)) << np.uint64(32)
    counts = rng.zipf(1.6, len(place)).clip(max=1 << 40)
    table = lm.LogFrequencyFilter.of({2: {0: lm.build_shard(place, counts)}}, {2: 1})
    q = table.lookup(2, place)
    assert (q >= lm.quantised(counts)).all() and (q > lm.quantised(counts)).mean() < 0.005
    absent = np.setdiff1d(rng.integers(0, 1 << 32, 100_000, dtype=np.uint64) << np.uint64(32), place)
    assert (table.lookup(2, absent) > 0).mean() < 0.005
    assert lm.expected(np.array([0, 1, 2])).tolist() == [0.0, 1.0, pytest.approx(30 / 13)]


def test_lm_sums_to_one(spark):
    """Over all tokens that may follow a history the probabilities add up to about 1."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=40)) for _ in range(300)]
    text = [(i, t) for i, t in enumerate(texts)]
    train = [ws for i, t in text if zlib.crc32(str(i).encode()) % 10 for ws in [[*t.split(), None]]]
    c1 = Counter(w for ws in train for w in ws)
    c2 = Counter(p for ws in train for p in zip([None, *ws], ws, strict=False))
    q = {p: float(lm.expected(lm.quantised(np.array([c])))[0]) for p, c in c2.items()}
    n, v = sum(c1.values()), len(c1)
    for h in [w for w, _ in c1.most_common(8)]:
        total = sum((min(q.get((h, w), 0), c1[h]) + 500 * (c1[w] + 0.1) / (n + 0.1 * (v + 1))) / (c1[h] + 500) for w in [*c1, "unseen"])
        assert 0.9 < total < 1.1


def components_by_force(corpus, percent=85):
    sets = []
    for _, t in corpus:
        w = words(t, True)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(corpus):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(corpus)]


def edited(seed=4, groups=8):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(900)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 70, 400, 900]))]
        for _ in range(rng.randint(2, 14)):
            share = rng.choice([0, 0.005, 0.015, 0.02, 0.03])
            rows.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates(spark, docs, corpus):
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs)[0].select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(components_by_force(corpus))
    more = edited()
    df = spark.createDataFrame(more, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in neardup.near_duplicates(df)[0].select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(components_by_force(more))


def similar(n, seed=9, shared=110, own=21):
    """Texts of one group whose pairs have a similarity of about 0.7 and no link."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(shared)]
    return [(i, " ".join(base + [f"t{i}x{rng.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize("block", [16, 4096])
def test_near_duplicates_long_lists(spark, block):
    """Lists longer than a block: central rounds, several homes and slices."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(160)]
    rows = [" ".join(rng.choice(vocabulary) if rng.random() < s else w for w in base) for s in (0, 0.004, 0.01, 0.02, 0.04) for _ in range(18)]
    rows += [t for _, t in similar(40)]
    rng.shuffle(rows)
    more = list(enumerate(rows))
    df = spark.createDataFrame(more, SCHEMA).repartition(5)
    for percent in (85, 70):
        got = sorted(tuple(r) for r in neardup.near_duplicates(df, block=block, percent=percent)[0].select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == sorted(components_by_force(more, percent))


def test_near_duplicates_rows_stay_linear(spark, tmp_path, monkeypatch):
    n = 1200
    made = []
    keep = neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, path: (lambda out: (made.append((path, out.count())), out)[1])(keep(df, path)))
    found = neardup.near_duplicates(spark.createDataFrame(similar(n), SCHEMA).repartition(4), percent=80)[0]
    assert found.where("kept").count() == n
    per_list = max(c for p, c in made if "entries" in p or "members" in p)
    assert per_list <= 64 * n and max(c for p, c in made if "entries" not in p and "members" not in p and "parts" not in p and "lists" not in p and "main" not in p) < 20 * n


def test_overlaps():
    rng = np.random.default_rng(2)
    for n, m, size, space in ((3, 4, 20, 60), (40, 300, 128, 300), (64, 900, 200, 2500)):
        a, b = ([np.sort(rng.choice(space, size, replace=False)).astype(np.uint32) for _ in range(k)] for k in (n, m))
        assert (neardup.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
    assert neardup.overlaps([np.empty(0, np.uint32)], [np.empty(0, np.uint32)]).tolist() == [[0]]


def test_near_duplicates_shapes(spark, odd, empty):
    found, _ = neardup.near_duplicates(odd.select("text", "doc_id"))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in found.collect()) == [("7", 1, "7", True), ("7", 1, "7", True), ("None", 0, "None", True), ("None", 1, "7", False)]
    assert sorted(str(r["doc_id"]) for r in neardup.keep_one(odd).collect()) == ["7", "None"]
    with pytest.raises(TypeError, match="integral"):
        neardup.near_duplicates(odd.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert neardup.keep_one(odd).columns == odd.columns and neardup.keep_one(empty).count() == 0
    assert 0 < neardup.least_shared(128, 85) < 109


def test_exchange_tree(spark, tmp_path):
    """Counts through three levels equal those of one."""
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << 64, 500, dtype=np.uint64))
    has = {s: np.sort(rng.choice(keys, 60, replace=False)) for s in range(40)}
    want = Counter(k for h in has.values() for k in h.tolist())
    for splits, fan in (((6,), 512), ((4, 4, 3), 4), ((4, 9), 8)):
        for checked in (False, True):
            ranges = G.Ranges(splits)

            def send(batches, ranges=ranges, checked=checked):
                for b in batches:
                    for s in b.column(0).to_pylist():
                        yield G.sent(s, 1, ranges, has[s], np.full(60, 2), has[s].astype(np.uint32) if checked else None)
                        yield G.passed(s, 9, 4, b"as it is")

            def final(place, counts):
                return counts.astype(np.uint64), [(5, bytes([len(place) % 256]))]

            rows = spark.range(0, 40, 1, 3).mapInArrow(send, G.SENT)
            out = G.exchange(rows, 40, {1: ranges}, {1: final}, f"file://{tmp_path}/{len(splits)}{checked}", fan).collect()
            assert sum(r["kind"] == 9 for r in out) == 40 and sum(r["blob"][0] for r in out if r["kind"] == 5) == len(want)
            for s, h in has.items():
                got = G.unpacked([bytes(r["blob"]) for r in sorted(out, key=lambda r: r["bucket"]) if r["kind"] == 1 and r["seg"] == s], np.uint64)
                assert got.tolist() == [2 * want[k] for k in h.tolist()]


def test_windows_need_all_96_bits(tmp_path, monkeypatch):
    """Windows of equal 64-bit names are told apart by the further 32 bits, within a segment too."""
    w = object.__new__(substring.Words)
    w.window_names = lambda at: np.zeros(len(at), np.uint64)
    w.window_checks = lambda at: np.array([3, 1, 3, 2], np.uint32)
    name, check, count, group = w.named(np.arange(4))
    assert check.tolist() == [1, 2, 3] and count.tolist() == [1, 1, 2] and group.tolist() == [2, 0, 2, 1] and not name.any()
    _, _, total, merged, _ = G._merged([G.encode(np.zeros(2, np.uint64), np.ones(2, np.int64), np.array([1, 2], np.uint32), 64), G.encode(np.zeros(2, np.uint64), np.ones(2, np.int64), np.array([2, 3], np.uint32), 64)])
    assert total.tolist() == [1, 2, 1] and merged.tolist() == [0, 1, 1, 2]


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of over 5 MB, its copy, and a short one."""
    rng = random.Random(20)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(vocabulary, k=800_000))
    rows = [(1, text), (2, text), (3, "a short text of its own"), (None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(2).cache()


def test_long_texts(spark, long_docs, tmp_path):
    """Texts beyond every block and segment, in each operator."""
    rows, df = long_docs
    text, n = rows[0][1], 800_000
    assert len(text) > 5_000_000
    got = {r["doc_id"]: r for r in quality.quality_rules(df, keep=["doc_id"]).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == n and got[1]["word_chars"] == len(text) - n + 1 and got[1]["kept"]
    media.write_archives(df, f"file://{tmp_path}/m")
    sha = {r["key"]: bytes(r["media"]) for r in media.read_media(spark, f"file://{tmp_path}/m").collect()}
    assert media.png_samples(sha["1"])[0].rstrip(b"\0") == text.encode()
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in classifier.quality_classifier(df, labels, keep=["doc_id"]).collect())
    got = {r["doc_id"]: r for r in substring.substring_dedup(df, keep=["doc_id"], digest=True).collect()}
    assert (got[1]["n_words"], got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (n, n, n, 0)
    got = {r["doc_id"]: r for r in lm.lm_scores(df).collect()}
    assert got[1]["n_tokens"] == n + 1 and got[1]["score"] == pytest.approx(got[2]["score"]) and math.isfinite(got[1]["score"])
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df)[0].collect()}
    grams = len({tuple(x) for x in zip(*(text.split()[k:] for k in range(5)), strict=False)})
    assert got[1]["n_shingles"] == grams and [got[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 3]


def test_long_texts_tokenised(spark, long_docs, tmp_path):
    rows, df = long_docs
    ids = ids_of([rows[0]])[1]
    manifest = tokens.write_tokens(df, f"file://{tmp_path}/t")
    got = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, f"file://{tmp_path}/t", manifest).collect()}
    assert np.array_equal(got[1], ids) and np.array_equal(got[2], ids) and got[None] == [2]
    pieces = [r for r in packing.pack(df).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in pieces) == len(ids) and all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    r = next(r for r in bpe.encode_texts(df, keep=["doc_id"], digest=True).collect() if r["doc_id"] == 1)
    assert r["decoded_sha256"] == hashlib.sha256(rows[0][1].encode()).hexdigest()


def test_null_and_tied_ids_row_by_row(spark, tmp_path):
    rows = [(None, "null one"), (None, "null two"), (5, "five a"), (5, "five b"), (5, "five b"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = tokens.write_tokens(df, f"file://{tmp_path}/t")
    got = tokens.read_tokens(spark, f"file://{tmp_path}/t", manifest).collect()
    want = sorted((str(i), ids_of([(0, t)])[0].tolist()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == [None, None, 5, 5, 5, 5, 6]
    spots, seen = {}, []
    for r in packing.pack(df).collect():
        assert r["start"] == 0 and r["length"] == r["doc_tokens"]
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.append((str(r["doc_id"]), r["ids_crc32"]))
    assert sorted(seen) == sorted((str(i), zlib.crc32(ids_of([(0, t)])[0].tobytes())) for i, t in rows)
    for parts in spots.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_scratch_leaves_nothing(spark, docs, tmp_path):
    from newsloom.llm._shared import run_dir, scratch, shared_dir

    with scratch():
        run_dir(spark, "unused")
        substring.substring_dedup(docs, keep=["doc_id"], digest=True).write.parquet(f"{tmp_path}/out")
        before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
        assert any(x.startswith("substring-") for x in before)
    after = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    assert len(before - after) == 2 and spark.read.parquet(f"{tmp_path}/out").count() == docs.count()

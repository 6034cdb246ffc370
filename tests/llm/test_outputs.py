"""Scoring, media, packing, chat and training order: round trips and brute force."""

import cProfile
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paretoflow.llm import chat, packing, scoring, telephony, tokens, training_order
from tests.llm.conftest import prose, rows


def test_wav_round_trip(docs, none):
    found = telephony.decode(telephony.store(telephony.payloads(docs))).collect()
    texts = Counter((r[0], r[1] or "") for r in rows())
    seen = Counter()
    for r in found:
        payload = bytes(r["payload"])
        text = payload[: r["n_bytes"]].decode()
        seen[(r["doc_id"], text)] += 1
        assert len(payload) % 576 == 0 and len(payload) >= 576 and set(payload[r["n_bytes"] :]) <= {255}
        codec, data = telephony.read_wav(bytes(r["media"]))
        assert data == payload and f"codec={telephony.NAMES[codec]}" in r["feature"]
        assert len(r["pcm"]) % 4 == 0
    assert seen == texts
    assert len({r["feature"].split(";")[0] for r in found}) == 3
    assert telephony.decode(telephony.store(telephony.payloads(none))).count() == 0
    with pytest.raises(ValueError):
        telephony.read_wav(b"RIFFxxxxAVI ")


def test_law_tables():
    mu, a = telephony.EXPAND[telephony.MU_LAW], telephony.EXPAND[telephony.A_LAW]
    # Fixed values of G.711: silence, largest and smallest steps.
    assert mu[0xFF] == 0 and mu[0x7F] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert sorted(mu) == sorted(-mu) and len(set(a.tolist())) == 256


@settings(max_examples=10, deadline=None)
@given(st.binary(min_size=576, max_size=576), st.binary(min_size=576, max_size=576))
def test_adpcm_against_one_block_at_a_time(x, y):
    def plain(block):
        sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [sample]
        for byte in block[4:]:
            for n in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = step >> 3
                for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                    change += part if n & bit else 0
                sample = max(-32768, min(32767, sample - change if n & 8 else sample + change))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[n & 7])))
                out.append(sample)
        return out

    got = telephony.decode_adpcm(np.frombuffer(x + y, np.uint8).reshape(2, 576))
    assert got.tolist() == [plain(x), plain(y)]


def test_rank_file_and_tokenizer_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encode = tokens.encoding(tokens.vocabulary_path()).encode_ordinary
    for text in [r[1] or "" for r in rows()] + ["<|endoftext|> it's  über\n\n 123 a…b", "\u2028 x\t\t", "a" * 2000]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_packed_ids_are_those_of_the_tokenizer(spark):
    """Added tokens inside texts have their own ids, as in a tokenizer left at its defaults."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n it's", "<|endoftext| >", "<|ENDOFTEXT|>", "plain über"]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    ids = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got}
    assert ids == {k: [*t.encode(x, add_special_tokens=False).ids, packing.END_ID] for k, x in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275, packing.END_ID]


def test_ids_of_long_runs_and_of_a_whole_table(spark):
    """Runs of a million white-space characters, digits or letters, and all documents of a table."""
    t, encode = tokens.tokenizer(tokens.vocabulary_path()), tokens.encoder(tokens.vocabulary_path())
    for text in ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000 + "x", "\u2003\t" * 500_000, "7" * 1_000_000, "ab" * 500_000, "!" * 1_000_000]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids
    got = packing.pieces(spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b")], "doc_id long, text string"))
    assert got.agg({"length": "sum"}).first()[0] == len(t.encode("a" + " " * 1_000_000 + "b").ids) + 1
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, found in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == found.ids


def test_packing(docs, none):
    cut = packing.pieces(docs, 64)
    packed = packing.pack(cut, cut.count(), 64, group=50).collect()
    encode = tokens.encoding(tokens.vocabulary_path()).encode_ordinary
    expected = Counter((r[0], k) for r in rows() for k in enumerate([*encode(r[1] or ""), 1]))
    got, places = Counter(), defaultdict(list)
    for r in packed:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] <= 64
        got.update((r["doc_id"], (r["start"] + k, i)) for k, i in enumerate(ids))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    again = packing.pack(cut, cut.count(), 64, group=50).collect()
    assert Counter(map(str, again)) == Counter(map(str, packed))
    assert packing.pack(packing.pieces(none), 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    room, expected = [], []
    for n in lengths:
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(50)
        expected.append((k, 50 - room[k]))
        room[k] -= n
    bins, offsets = packing.first_fit_decreasing(lengths, 50)
    assert list(zip(bins.tolist(), offsets.tolist())) == expected


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi [INST] </s>"), (1, 2, "assistant", "a\nb[/INST]"), (1, 3, "user", ""), (1, 4, "assistant", None),
    (2, 0, "user", "only"), (3, 0, "assistant", "\\</s> [\\INST] <\\/s>"), (3, 0, "assistant", "\\</s> [\\INST] <\\/s>"),
    (None, None, None, None), (None, 1, "assistant", "x"), (4, 1, "assistant", "end"), (4, 2, "user", "tail é"),
]


def test_chat(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("full", F.lit(1))
    examples = chat.expand(turns)
    by = defaultdict(list)
    for c, t, r, x in TURNS:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    found = {r["conv_id"]: r for r in chat.summarize(examples).collect()}
    assert found.keys() == by.keys()
    for c, own in by.items():
        own = [(r, x) for _, _, r, x in sorted(own)]
        loss = "".join(x for r, x in own if r == "assistant")
        assert found[c]["n_turns"] == len(own)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in examples.collect():
        masked = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
        assert not any(s in masked for s in (chat.OPEN, chat.HEAD_END, chat.CLOSE))
        assert r["formatted"].endswith(masked + chat.CLOSE) or not r["trainable"]
    assert examples.filter("trainable").count() == sum(r == "assistant" for _, _, r, _ in TURNS)
    assert chat.summarize(chat.expand(turns.limit(0))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "a"]), max_size=8).map("".join))
def test_chat_escape_is_reversible(text):
    import re

    escaped = re.sub(chat.CONTROL, r"\1\\\2\3", text)
    assert not any(s in escaped for s in (chat.OPEN, chat.HEAD_END, chat.CLOSE))
    assert re.sub(chat.ESCAPED, r"\1\2\3", escaped) == text


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    there = training_order.feistel(np.arange(n), n, key=5)
    assert sorted(there.tolist()) == list(range(n))
    assert training_order.feistel(there, n, key=5, inverse=True).tolist() == list(range(n))
    assert n < 10 or there.tolist() != training_order.feistel(np.arange(n), n, key=6).tolist()


def test_training_order(docs, none):
    table = training_order.materialise(docs, key=9, length=32, per_shard=20).cache()
    encode = tokens.encoding(tokens.vocabulary_path()).encode_ordinary
    expected = Counter()
    for doc, text, *_ in rows():
        ids = [*encode(text or ""), 1]
        ids += [0] * (-len(ids) % 32)
        expected.update(tuple(ids[k : k + 32]) for k in range(0, len(ids), 32))
    stored = [r for r in training_order.resume(table, 0, 20).collect()]
    assert [r["slot"] for r in stored] == list(range(sum(expected.values())))
    assert Counter(tuple(np.frombuffer(bytes(r["ids"]), "<u2").tolist()) for r in stored) == expected
    assert [r["slot"] for r in training_order.resume(table, 57, 20).collect()] == list(range(57, len(stored)))
    again = training_order.materialise(docs, key=9, length=32, per_shard=20)
    key = lambda t: sorted((r["shard"], hashlib.sha256(bytes(r["data"])).hexdigest()) for r in t.collect())
    assert key(again) == key(table)
    assert training_order.materialise(none).count() == 0


def test_scoring(docs, none):
    found = scoring.score(docs).collect()
    counts, per = Counter(), []
    for doc, text, *_ in rows():
        t = (text or "").encode().lower().split() + [b"\n"]
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2
        per.append((doc, held, t))
        if not held:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((d, h, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for d, h, t in per)
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in found) == expected
    assert all(r["score"] < 0 for r in found)
    assert scoring.score(none).count() == 0


def test_tokens_of_a_chunk_are_looked_up_together():
    """As texts are cut and words classed one by one, without a call for each word."""
    texts = [b"", b" \t\n", b"One\x0btwo one", b"\x00 A\x00b \x1c \xc3\x84h\xff", prose(11, 3000).encode(), b"end\n", b"qo o xo yxo"]
    distinct, at, sizes = scoring.encoded(texts)
    words = distinct.to_pylist()
    assert [words[k] for k in at] == [w for t in texts for w in scoring.tokens(t)] and len(set(words)) == len(words)
    assert sizes.tolist() == [len(scoring.tokens(t)) for t in texts]
    known = small_symbols()
    class_of = [1 if w[-scoring.ENDING :][::-1] < b"o" else 2 for w in words]
    expected = [known.words.get(w, known.starts[k + 1] - 1) for w, k in zip(words, class_of)]
    assert known.ids(distinct, {}).tolist() == expected
    assert scoring.encoded([])[2].tolist() == [] and len(scoring.encoded([])[0]) == 0

    def calls(n: int) -> int:
        profile = cProfile.Profile()
        some = [b"w%d" % k for k in range(n)]
        profile.runcall(known.ids, some, {})
        return sum(x.callcount for x in profile.getstats())

    assert calls(20000) < 2 * calls(20)


def small_symbols():
    """Two words in one class, three in another, and rare words in both."""
    words = {b"\n": 1, b"aa": 2, b"ba": 3, b"xo": 5, b"yo": 6, b"zo": 7}
    counts = np.array([0, 40, 50, 60, 10, 70, 80, 90, 20], float)
    return scoring.Symbols(words, [b"o"], np.array([1, 2, 5, 9]), counts, np.array([0.0, 10, 20]), np.array([0.0, 3, 4]), 420, 13)


def test_network_is_normalised_and_learns():
    known = small_symbols()
    assert known.ids([b"aa", b"qqa", b"yo", b"wo", b"\n"], {}).tolist() == [2, 4, 6, 8, 1]
    rng, network = np.random.default_rng(2), scoring.Network(known)
    n = known.size
    # The symbol before last decides the next one, across classes and within them.
    after = {2: 5, 3: 6, 5: 2, 6: 3, 7: 1}
    far, near = rng.choice(list(after), 4000), rng.choice([2, 3, 5, 6, 7], 4000)
    cells = (far * n + near) * n + np.array([after[f] for f in far])
    network.study(cells, 30, rng)
    every = np.array([(f * n + m) * n + t for f in range(n) for m in range(n) for t in range(1, n)])
    assert np.allclose((10 ** network.log10(every)).reshape(n * n, n - 1).sum(1), 1, atol=1e-5)
    assert (10 ** network.log10(np.array([(f * n + 3) * n + t for f, t in after.items()])) > 0.5).all()


def test_word_probabilities_sum_to_one(spark):
    """Each word of a small vocabulary, and one unknown word of each class, after one and the same text."""
    data = [(k, " ".join(f"w{j % (k + 2)}{'aeiou'[j % 5]}" for j in range(60))) for k in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    dealt, blocks = scoring._dealt(docs)
    table = scoring.vocabulary(dealt, blocks)
    known = scoring.symbols(table)
    counts = Counter(w for k, t in data if zlib.crc32(str(k).encode()) % 7 != 2 for w in scoring.tokens(t.encode()))
    assert known.train_tokens == sum(counts.values()) and known.train_distinct == len(counts)
    assert known.counts.sum() == known.train_tokens and set(known.words) <= set(counts)
    network, n = scoring.Network(known), known.size
    own = known.classes()
    total = 0.0
    for word, c in counts.items():
        s = int(known.ids([word], {})[0])
        p = 10 ** network.log10(np.array([(0 * n + 2) * n + s]))[0]
        total += p if word in known.words else p * (c - scoring.DISCOUNT) / known.rare_total[own[s]]
    for k in range(1, len(known.starts) - 1):
        p = 10 ** network.log10(np.array([(0 * n + 2) * n + known.starts[k + 1] - 1]))[0]
        total += p * (scoring.DISCOUNT * known.rare_distinct[k] / known.rare_total[k] if known.rare_total[k] else 1.0)
    assert abs(total - 1) < 1e-4


def test_held_out_words_of_a_whole_table(spark):
    """The network is better than its start, which knows classes and shares but no context (-3.59 a token)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    total = scoring.score(docs).filter("held_out").agg({"score": "sum", "n_tokens": "sum"}).first()
    assert total["sum(score)"] / total["sum(n_tokens)"] > -3.3


def test_scores_beat_the_base_on_held_out_text(spark):
    """Two kinds of text with words of their own: contexts tell them apart."""
    a, b = (["".join(w) for w in zip(*[iter(prose(k, 400).replace(" ", ""))] * 4)][:60] for k in (41, 42))
    rng = np.random.default_rng(3)
    data = [(k, " ".join(rng.choice((a, b)[k % 2], 120))) for k in range(300)]
    found = scoring.score(spark.createDataFrame(data, "doc_id long, text string")).filter("held_out").collect()
    assert len(found) > 20 and sum(r["score"] - r["base_score"] for r in found) > 0.1 * sum(r["n_tokens"] for r in found)


def test_scores_do_not_depend_on_splits(spark, monkeypatch):
    """Many chunks; other splits, other tasks, other order: the same scores."""
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 20000)
    data = [(k, prose(300 + k, 40 + k % 50)) for k in range(240)] + [(7, prose(307, 47))] * 3
    found = []
    for parts, shuffles, size in ((1, "3", "64k"), (11, "7", "128m")):
        monkeypatch.setattr(scoring, "COPIES", 2 if parts == 1 else 1000)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = spark.createDataFrame(data[::-1] if parts > 1 else data, "doc_id long, text string").repartition(parts)
        found.append(sorted((r["doc_id"], r["score"], r["base_score"], r["n_known"]) for r in scoring.score(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found[0]) == 243 and [x[0] for x in found[0]] == [x[0] for x in found[1]]
    once = [[x for x in f if x[0] != 7] for f in found]
    assert [x[3] for x in once[0]] == [x[3] for x in once[1]] and [x[2] for x in once[0]] == pytest.approx([x[2] for x in once[1]])
    # Only where the copies of the repeated row lie differs.
    assert np.abs(np.array([x[1] for x in once[0]]) - np.array([x[1] for x in once[1]])).max() < 0.06 * max(abs(x[1]) for x in once[0])


def test_equal_deals_give_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 3000)
    data = [(k, prose(300 + k, 40 + k % 50)) for k in range(160)]
    found = []
    for parts, shuffles in ((2, "2"), (9, "5")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(parts)
        found.append([r["score"] for r in scoring.score(df).orderBy("doc_id").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == pytest.approx(found[1], abs=1e-6)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, " \n" * 500_000 + "end", "a <|endoftext|> b"])
def test_training_order_of_long_white_space_and_added_tokens(spark, text):
    encode = tokens.encoder(tokens.vocabulary_path())
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = training_order.sequences(df).orderBy("part").collect()
    ids = np.concatenate([np.frombuffer(r["ids"], "<u2") for r in rows])
    want = [*encode(text), training_order.END_ID]
    assert rows[0]["doc_tokens"] == len(want) and ids[: len(want)].tolist() == want and not ids[len(want) :].any()

"""The operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from math import ceil

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chorale.llm import _tokens, chat, fingerprint, langid, mixing, neardup, packing, quality, queries, sharding, urlfilter, warc
from chorale.llm._common import components, numbered, ranked_within

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- shared


def test_numbers_and_ranks(spark):
    df = spark.createDataFrame([(i * 7919 % 1009, "a" if i % 3 else "b") for i in range(500)], "x long, k string")
    got = sorted((r["row_number"], r["x"]) for r in rows(numbered(df, ["x"])))
    assert [n for n, _ in got] == list(range(500)) and [x for _, x in got] == sorted(x for _, x in got)
    ranked = rows(ranked_within(df, "k", ["x"]))
    for k in "ab":
        assert sorted(r["rank"] for r in ranked if r["k"] == k) == list(range(sum(r["k"] == k for r in ranked)))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {x: find(x) for x in parent}


# ---------------------------------------------------------------- 1 WARC


def test_warc_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(9001, "http://a", "same"), (9002, None, "same"), (9003, "http://b", "same"), (9004, "c", None), (9005, "d", ""), (9006, "e", "ü" * 100_000)], "page_id long, url string, html string")
    pages = pages.union(extra)
    source = {r["page_id"]: (r["html"] or "").encode() for r in rows(pages)}
    groups = defaultdict(list)
    for i, p in source.items():
        groups[p].append(i)
    got = {r["page_id"]: r for r in rows(warc.round_trip(pages))}
    assert got.keys() == source.keys()
    for i, payload in source.items():
        top = max(groups[payload])
        assert got[i]["payload_bytes"] == len(payload)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == top else ("revisit", top))


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**9])
def test_warc_ranges_own_each_record_once(size):
    records = [warc.record(i, f"http://x/{i}", bytes([i % 256]) * (i * 37), None) for i in range(30)]
    raw = b"".join(warc.member(r) for r in records)
    found = [whole for a in range(0, len(raw), size) for _, whole in warc.scan(io.BytesIO(raw), a, min(a + size, len(raw)))]
    assert found == records


def test_warc_refuses_false_magic_and_ends_in_zero():
    big = warc.member(b"WARC/1.1\r\n\r\n" + random.Random(1).randbytes(17 << 20))
    assert big.endswith(b"\0") and warc.member(b"WARC/1.1\r\n\r\n").endswith(b"\0")
    raw = b"junk" + warc.MAGIC + b"more" + zlib.compress(b"x") + warc.member(warc.record(1, "u", b"p", None))
    assert [warc.parsed(w)[1] for _, w in warc.scan(io.BytesIO(raw), 0, len(raw))] == [b"p"]
    assert len(list(warc.scan(io.BytesIO(big), 0, len(big)))) == 1
    with pytest.raises(ValueError):
        list(warc.scan(io.BytesIO(big[:-1000]), 0, len(big)))
    with pytest.raises(ValueError):
        list(warc.scan(io.BytesIO(warc.member(b"WARC/1.1 without an end")), 0, 99))


def test_warc_odd_rows(spark):
    df = spark.createDataFrame([(None, "u", "p", 1), (5, "u", "p", 2), (5, "u", "p", 3), (4, None, "p", 4), (None, None, None, 5)], "page_id long, url string, html string, record_type int")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in rows(warc.round_trip(df))), key=repr)
    assert got == sorted([(None, "revisit", 5), (5, "response", None), (5, "response", None), (4, "revisit", 5), (None, "response", None)], key=repr)
    assert rows(warc.round_trip(df.limit(0))) == []


def test_warc_shared_payloads_and_repeated_ids(spark):
    table = [(None, f"u{i}", "shared") for i in range(50)] + [(i, "u", "shared") for i in range(300)] + [(7, "u", "other")] * 2 + [(8, "u", "other")] + [(None, "n", "alone")] * 3
    df = spark.createDataFrame(table, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows(warc.round_trip(df.repartition(9)))), key=repr)
    want = [(None, 6, "revisit", 299)] * 50 + [(i, 6, "revisit", 299) for i in range(299)] + [(299, 6, "response", None)]
    want += [(7, 5, "revisit", 8)] * 2 + [(8, 5, "response", None)] + [(None, 5, "response", None)] * 3
    assert got == sorted(want, key=repr)


def test_warc_long_urls(spark):
    long, wide = "http://x/" + "u" * 100_000, "http://x/" + "漢" * 20_000
    df = spark.createDataFrame([(1, "http://x/1", "same"), (2, "http://x/2", "same"), (3, long, "same"), (4, wide, "other")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in rows(warc.round_trip(df))}
    assert got == {1: ("revisit", 4, 3), 2: ("revisit", 4, 3), 3: ("response", 4, None), 4: ("response", 5, None)}
    assert next(r["url"] for r in rows(warc.round_trip(df)) if r["page_id"] == 3) == long


# ---------------------------------------------------------------- 2 sharding


@given(st.integers(1, 3000), st.integers(0, 2**31))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    x = np.arange(n)
    p = sharding.permute(x, n, key)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, key, inverse=True) == x).all()


def plain_place(n, rows, shards, key=1):
    """Six rounds over the two halves of the next power of four, walking until the number is below rows."""
    bits, m = 1, (1 << 64) - 1
    while 4**bits < rows:
        bits += 1

    def scrambled(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    while True:
        left, right = divmod(n, 1 << bits)
        for r in range(6):
            salt = (key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & m
            left, right = right, left ^ scrambled(right ^ salt) % (1 << bits)
        n = left << bits | right
        if n < rows:
            return n % shards, n // shards


def test_sharding(spark, sf_dir, docs, odd_texts):
    d = documents(spark, sf_dir)
    got = rows(sharding.shard(d, shards=7))
    texts = {r["doc_id"]: r["text"] for r in rows(d)}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    by = defaultdict(list)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, rows(sharding.shard(d.repartition(5), shards=7))))
    number = {i: n for n, i in enumerate(sorted(texts))}
    assert [(r["shard"], r["slot"]) for r in got] == [plain_place(number[r["doc_id"]], len(got), 7) for r in got]
    odd = docs([(i // 2 if i else None, t, "en", "s") for i, t in enumerate(odd_texts)])
    assert len(rows(sharding.shard(odd, shards=40))) == len(odd_texts)
    assert rows(sharding.shard(odd.limit(0), shards=40)) == []


# ---------------------------------------------------------------- 3 chat


@given(st.text(alphabet=st.sampled_from(list("<|~>[]/INSTs a"))) | st.text())
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(s):
    e = chat.escape(s)
    assert chat.unescape(e) == s
    assert not any(c in e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_chat(spark, sf_dir, monkeypatch):
    got = {r["conv_id"]: r for r in rows(queries.op3_chat(spark, sf_dir))}
    want = defaultdict(list)
    for r in rows(spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn")):
        want[r["conv_id"]].append((r["role"], r["text"] or ""))
    want[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    check_conversations(got, want)


def check_conversations(got, want):
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(chat.render(turns)[0])


def test_chat_odd_rows(spark):
    data = [(1, 1, "assistant", "é漢字 \n x <|end|> <~|"), (1, 0, None, None), (1, 2, "assistant", None), (1, 3, "assistant", "  "), (None, None, "user", "u"), (2, 0, "<|turn|>", "[INST]")]
    data += [(3, i, "user" if i % 2 else "assistant", "long text here " * 2000) for i in range(80)]
    df = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, part string")
    want = defaultdict(list)
    for c, _, role, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0)):
        want[c].append((role or "", text or ""))
    out = chat.format_conversations(df)
    assert {r["part"] for r in rows(out.filter("conv_id = 3"))} == {0, 1, 2}
    check = {r["conv_id"]: r for r in rows(chat.digests(out))}
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (check[c]["n_turns"], check[c]["loss_chars"]) == (len(turns), len(loss))
        assert check[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert rows(chat.digests(chat.format_conversations(df.limit(0)))) == []


# ---------------------------------------------------------------- 4 packing


def test_plan_against_bounds():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randrange(4, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 60))]
        made = packing.plan(dict(Counter(lengths)), capacity)
        assert Counter(x for p, n in made for x in p for _ in range(n)) == Counter(lengths)
        assert all(sum(p) <= capacity and n > 0 for p, n in made)
        bins: list[int] = []
        for x in sorted(lengths, reverse=True):
            fit = [i for i, gap in enumerate(bins) if gap >= x]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= x
            else:
                bins.append(capacity - x)
        assert ceil(sum(lengths) / capacity) <= sum(n for _, n in made) <= len(bins) + 1
    many = Counter(rng.randrange(1, 1025) for _ in range(50000))
    assert sum(n for _, n in packing.plan(dict(many), 1024)) <= 1.02 * sum(k * n for k, n in many.items()) / 1024


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_on_whole_tables(spark):
    t, own = tokenizer(), _tokens.encoder()
    for r in rows(documents(spark, "/root/testdata/sf0.01")):
        assert own.ids(r["text"]).tolist() == t.encode(r["text"], add_special_tokens=False).ids


LONG_TEXTS = [" " * 100_000 + "a", "a" + "\n" * 100_000, "a" + " \n" * 60_000 + "b" + "\u3000" * 40_000 + " c", "x" * 200_000, "漢" * 50_000, "\x1c\x85 " * 20_000]


def test_ids_of_long_unbroken_texts():
    t, own = tokenizer(), _tokens.encoder()
    for text in LONG_TEXTS:
        assert own.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(own.ids(" " * 3_000_000)) == len(own.ids("é" * 3_000_000)) == 3_000_000


_MARKS = (chat.TURN, chat.TEXT, chat.END)


@given(st.lists(st.one_of(st.sampled_from([*_MARKS, "<|endoftext|>", " ", "\n\n", "don't"]), st.text(max_size=12)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_ids_and_offsets_equal_the_tokenizers(parts):
    from tokenizers import AddedToken

    text = "".join(parts)
    t = tokenizer() if not _MARKED else _MARKED[0]
    if not _MARKED:
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in _MARKS])
        _MARKED.append(t)
    want, own = t.encode(text, add_special_tokens=False), _tokens.encoder(None, _MARKS)
    ids = own.ids(text)
    assert ids.tolist() == want.ids
    assert list(zip(*(x.tolist() for x in own.offsets(text, ids)), strict=True)) == want.offsets


_MARKED: list = []


def test_sums_hold_every_combination():
    rng = random.Random(9)
    for _ in range(150):
        counts = np.array([0] + [rng.choice((0, 0, 1, 2)) for _ in range(30)], dtype=np.int64)
        sums = packing.Sums(counts, 3)
        for _ in range(25):
            total = rng.randrange(1, 31)
            have = [x for x in range(31) for _ in range(counts[x])]
            some = any(sum(c) == total for k in (1, 2, 3) for c in itertools.combinations(have, k))
            found = sums.find(total)
            assert (found is not None) == some
            if found:
                assert sum(found) == total and all(counts[x] >= found.count(x) for x in found)
                for x in found if rng.random() < 0.5 else ():
                    counts[x] -= 1


def test_ids_with_added_tokens(docs):
    t = tokenizer()
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> \n", "<|endoftext|", "é <|endoftext|>\n\n 漢字 don't", "<|<|endoftext|>|>", "plain"]
    got = rows(packing.pack(docs([(i, x, "en", "web") for i, x in enumerate(texts)]), keep_ids=True))
    assert {r["doc_id"]: r["ids"] for r in got} == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}


def check_packing(got, texts, capacity=1024):
    t = tokenizer()
    encode = lambda text: t.encode(text, add_special_tokens=False).ids
    held, places = defaultdict(list), defaultdict(list)
    for r in got:
        held[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert held.keys() == texts.keys()
    for i, text in texts.items():
        ids = [*encode(text or ""), 2]
        at = 0
        for p, r in enumerate(sorted(held[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (p, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
            assert 0 < r["length"] <= capacity and (p == 0 or r["length"] == capacity)
        assert at == len(ids) and len(held[i]) == ceil(len(ids) / capacity)
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    return len(places), total


def test_packing(spark, sf_dir, docs, odd_texts):
    d = documents(spark, sf_dir)
    bins, total = check_packing(rows(packing.pack(d)), {r["doc_id"]: r["text"] for r in rows(d)})
    assert bins <= ceil(total / 1024) + 2
    odd_texts = [*odd_texts, *LONG_TEXTS]
    odd = docs([(i, t, "en", "s") for i, t in enumerate(odd_texts)])
    check_packing(rows(packing.pack(odd)), dict(enumerate(odd_texts)))
    kept = rows(packing.pack(odd, keep_ids=True))
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in kept)
    assert rows(packing.pack(odd.limit(0))) == []
    twice = odd.union(odd)
    assert len(rows(packing.pack(twice))) == 2 * len(kept)


# ---------------------------------------------------------------- 5 language ID


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(3)
    tables = [rng.normal(size=(int(n), 3)).astype(np.float32) * 4 for n in rng.integers(1, 7, 25)]
    for table, labels in zip(tables, langid.viterbi(tables, 2.0), strict=True):
        cost = lambda p: sum(table[t, x] for t, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert cost(labels.tolist()) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=len(table)))), abs=1e-4)
    at = np.append(0, np.cumsum([len(t) for t in tables]))
    for table, found, exact in zip(tables, langid.label(np.concatenate(tables), at, 2.0), langid.viterbi(tables, 2.0), strict=True):
        assert (np.full(len(table), found) if isinstance(found, int) else found).tolist() == exact.tolist()


def test_language_held_out(spark, docs, odd_texts):
    sf = "/root/testdata/sf0.01"
    got = rows(queries.op5_langid(spark, sf))
    lang = {r["doc_id"]: r["lang"] for r in rows(documents(spark, sf))}
    assert len(got) == len(lang)
    tested = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in tested} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_spans_and_odd_rows(spark, docs, odd_texts):
    base = "the house was in the old town and they went there with their friends ", "das alte Haus und die Straße nicht weit von der schönen Stadt ", "ο άνθρωπος και η θάλασσα είναι "
    train = docs([(i, base[i % 3] * 5, ("en", "de", "el")[i % 3], "s") for i in range(30)] + [(99, "x", None, "s"), (98, None, "en", "s")])
    model = langid.train(train)
    text = base[0] * 3 + base[1] * 3 + base[2]
    assert [s[2] for s in langid.spans_of(text, model)] == ["en", "de", "el"]
    for n in (12, 300, 400, 1000, 10_000):  # the script excludes the others whatever the length of a word
        greek = ("θάλασσα" * n)[:n]
        got = rows(docs([(1, greek, None, None), (2, f"{greek} x", None, None)]).select(langid.predict(train, model).alias("p")))
        assert [r["p"]["lang_pred"] for r in got] == ["el", "el"]
    odd = docs([(i, t, None, None) for i, t in enumerate([*odd_texts, text, "123 !?"])])
    got = [r["p"] for r in rows(odd.orderBy("doc_id").select(langid.predict(odd, model).alias("p")))]
    assert [g["lang_pred"] for g in got[:3]] == ["und"] * 3 and got[-1]["lang_pred"] == "und"
    assert rows(odd.limit(0).select(langid.predict(odd, model).alias("p"))) == []
    assert langid.train(train.union(docs([(None, base[0], "xx", "s")]))).languages == ("de", "el", "en")  # a null id can't train
    with pytest.raises(ValueError):
        langid.train(docs([(i, "a b", f"l{i}", "s") for i in range(langid.LANGUAGES + 1)]))
    none = langid.train(odd)
    assert {r["p"]["lang_pred"] for r in rows(odd.select(langid.predict(odd, none).alias("p")))} == {"und"}


# ---------------------------------------------------------------- 6 quality


def plain_measures(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, sf_dir, docs, odd_texts, monkeypatch):
    d = documents(spark, sf_dir)
    extra = docs([(10**6 + i, t, "en", None) for i, t in enumerate([*odd_texts, "a b c " * 40, "q#*$%&|<>w\n" * 3])])
    both = d.select("doc_id", "text", "source").union(extra.select("doc_id", "text", "source"))
    source = {r["doc_id"]: r for r in rows(both)}
    got = rows(quality.measure(both))
    assert len(got) == len(source)
    hosts = defaultdict(list)
    for r in got:
        assert tuple(r[m] for m in quality.MEASURES) == plain_measures(source[r["doc_id"]]["text"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        hosts[source[r["doc_id"]]["source"]].append(r["base_failed"])
    n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    mean = f / n
    variance = max(sum(sum(x) ** 2 / len(x) for x in hosts.values()) / n - mean**2, 1e-9)
    strength = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6)
    bad = {h for h, x in hosts.items() if (sum(x) + mean * strength) / (len(x) + strength) > quality.MAX_HOST_RATE}
    assert bad == {None}
    kept = rows(quality.filtered(both))
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in got if r["kept"])
    for r in got:
        assert r["kept"] == (not r["base_failed"] and source[r["doc_id"]]["source"] not in bad)
        h = hosts[source[r["doc_id"]]["source"]]
        assert r["host_rate"] == pytest.approx((sum(h) + mean * strength) / (len(h) + strength), abs=1e-6)
    assert rows(quality.measure(extra.limit(0))) == [] and rows(quality.filtered(extra.limit(0))) == []
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)  # hosts joined by shuffle give the same rows
    assert sorted(map(repr, rows(quality.measure(both)))) == sorted(map(repr, got))
    assert sorted(map(repr, rows(quality.filtered(both)))) == sorted(map(repr, kept))


# ---------------------------------------------------------------- 7 mixing


def plain_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, target, rest = share * sum(sizes.values()), {}, set(order)
    while rest:
        level = (budget - sum(target.values())) / sum(weight[s] for s in rest)
        over = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in rest}
        target |= {s: most * sizes[s] for s in over}
        rest -= over
    return target


def test_mixing(spark, docs):
    d = documents(spark, "/root/testdata/sf0.01")
    extra = docs([(10**6 + i, t, "en", None) for i, t in enumerate([None, "", "a b c", "a " * 500, "b " * 90])])
    both = d.select("doc_id", "text", "source").union(extra.select("doc_id", "text", "source"))
    texts = {r["doc_id"]: r for r in rows(both)}
    got = rows(mixing.mix(both))
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len(WORDS.findall(texts[r["doc_id"]]["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[texts[r["doc_id"]]["source"]] += r["size"]
        taken[texts[r["doc_id"]]["source"]] += r["taken"]
    want = plain_targets(sizes)
    for r in got:
        s = texts[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 10, s
    assert sorted(map(repr, got)) == sorted(map(repr, rows(mixing.mix(both.repartition(7)))))
    assert rows(mixing.mix(extra.limit(0))) == []
    assert {r["taken"] for r in rows(mixing.mix(docs([(1, None, None, None), (1, "", None, "a")])))} == {0}


def test_multipliers_solve_the_dual(spark, monkeypatch):
    rng, most = random.Random(8), 2.0
    sizes = {s: Counter(rng.randrange(1, 3000) for _ in range(n)) for s, n in (("a", 400), ("b", 30), (None, 1), ("tiny", 2))}
    goals = []
    for (s, h), share in zip(sizes.items(), (1.4, 0.3, 1.9, 0.01), strict=True):
        total, n = sum(k * c for k, c in h.items()), sum(h.values())
        goals.append((s, total, share * total, total / n))
    histogram = spark.createDataFrame([(s, k, c) for s, h in sizes.items() for k, c in h.items()], "source string, size long, n long")
    df = spark.createDataFrame(goals, "source string, size long, target double, mean double")
    got = {r["source"]: r["lambda"] for r in rows(mixing.multipliers(histogram, df, most))}
    for s, _, target, mean in goals:
        taken = lambda x: sum(c * k * min(most, np.exp(min(50, x * k / mean))) for k, c in sizes[s].items())  # noqa: B023, E731
        low, high = -50.0, 50.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if taken(middle) < target else (low, middle)
        assert got[s] == pytest.approx(low, abs=2e-3) and taken(got[s]) == pytest.approx(target, rel=1e-4, abs=0.1)
    monkeypatch.setattr(mixing, "ITERATIONS", 2)
    with pytest.raises(ValueError):
        mixing.multipliers(histogram, df, most)


def test_mixed_rows_are_the_mix(spark, docs):
    table = [(None, "w " * (10 + i % 3), "en", "s") for i in range(60)] + [(5, "v " * 40, "en", "s")] * 9 + [(5, "u", "en", "t"), (6, None, "en", "t")]
    df = docs(table)
    planned, out = rows(mixing.mix(df)), rows(mixing.mixed(df))
    assert sum(r["copies"] for r in planned) == len(out) and all(r["kept"] == "x" for r in out)
    for size in (1, 10, 11, 12, 40):
        assert sum(r["copies"] for r in planned if r["size"] == size) == sum(len(WORDS.findall(r["text"])) == size for r in out)
    assert rows(mixing.mixed(df.limit(0))) == []


def test_slabs_bound_a_workers_memory():
    texts = pa.array([f"{'word ' * 400}{i}" for i in range(4000)])
    quality.measured(texts)  # the tables of powers stay
    tracemalloc.start()
    whole = quality.measured(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
    assert whole.to_pylist()[::997] == [quality.measured(texts.slice(i, 1)).to_pylist()[0] for i in range(0, 4000, 997)]


def test_mixed_keeps_texts_out_of_python(spark, docs):
    table = [(i // 2, f"{'w ' * (10 + i % 7)}{i // 4}", "en", "ab"[i % 3 % 2]) for i in range(400)] + [(1, "v " * 40, lang, None) for lang in ("en", "de", "fr")]
    df = docs(table)
    out = mixing.mixed(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert moved and not any("_row" in line or "text" in line for line in moved)
    decided = Counter()
    for r in rows(mixing.mix(df)):
        decided[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = rows(out)
    assert Counter((r["doc_id"], r["source"], len(WORDS.findall(r["text"]))) for r in got) == +decided
    assert max(Counter(map(tuple, got)).values()) <= 2 * max(Counter(map(tuple, rows(df))).values())


# ---------------------------------------------------------------- 8 fingerprints


def test_prefix_hashes():
    rng = random.Random(5)
    text = "".join(rng.choice("abü漢") for _ in range(400))
    other = text[100:250] + text[:60]
    a, b = (fingerprint.PrefixHash(fingerprint.points(t)) for t in (text, other))
    for _ in range(300):
        i, j = rng.randrange(len(text)), rng.randrange(len(other))
        plain = 0
        while i + plain < len(text) and j + plain < len(other) and text[i + plain] == other[j + plain]:
            plain += 1
        assert a.common_extension(i, b, j) == plain
    assert a.spans(24)[100] == b.spans(24)[0] and len(set(a.spans(24).tolist())) == len({text[i : i + 24] for i in range(377)})


def test_fingerprints(spark, sf_dir, docs, odd_texts):
    d = documents(spark, sf_dir).select("doc_id", "text").union(docs([(10**6 + i, t, None, None) for i, t in enumerate(odd_texts)]).select("doc_id", "text"))
    order = sorted(((r["doc_id"], r["text"] or "") for r in rows(d)), reverse=True)
    got = {r["doc_id"]: r for r in rows(fingerprint.fingerprints(d))}
    assert len(got) == len(order)
    prints, errors = {}, []
    for at, (i, text) in enumerate(order):
        other = order[(at + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert r["common_edited"] == common_start(text, edited) and r["common_next"] == common_start(text, other) and r["edited_by_next"]
        errors += [abs(r["near_edited"] - plain_likeness(text, edited)), abs(r["near_next"] - plain_likeness(text, other))]
    assert len(set(prints.values())) == len(prints)
    assert max(errors) <= 5 * 0.5 / fingerprint.SKETCH**0.5 and np.mean(errors) <= 0.03  # five deviations of a share of SKETCH
    for low, high in ((6, 24), (24, 512), (2000, 10**9)):
        some = [r for r in got.values() if low <= r["n_chars"] < high]
        assert np.mean([r["near_edited"] for r in some]) > 0.3


def common_start(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def plain_likeness(a, b):
    """Jaccard's likeness of the spans in the finest window of both."""
    if a == b:
        return 1.0
    w = 1 if max(len(a), len(b)) < 8 else 4 if max(len(a), len(b)) < 512 else 24
    x, y = ({t[i : i + w] for i in range(len(t) - w + 1)} if len(t) >= w else {t} if t else set() for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def test_fingerprint_odd_rows(spark, docs):
    one = rows(fingerprint.fingerprints(docs([(7, "abcdef", None, None)])))
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    ties = rows(fingerprint.fingerprints(docs([(None, "a", None, None), (None, "b", None, None), (3, "c", None, None), (3, "c", None, None), (3, "d", None, None), (4, None, None, None)])))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in ties) == [(False, 3)] * 3 + [(False, 4)] + [(True, 0)] * 2
    assert rows(fingerprint.fingerprints(docs([(1, "a", None, None)]).limit(0))) == []


# ---------------------------------------------------------------- 9 URL filters


def plain_verdict(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, str(best) if best else None, best.verdict if best else default


def test_url_rules(spark, sf_dir, monkeypatch):
    rules = [*queries.URL_RULES, urlfilter.Rule("allow", "com", "/en/"), urlfilter.Rule("block", "a.example.net"), urlfilter.Rule("block", "example.com", "/x/y")]
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/75?q", "http://com/en/", "http://xexample.com/en/7", "http://example.com", "ftp://a.example.net#f", "http://example.com/x/yz/1", "http://example.com/x/", "http://É.org/es/a b", "x://y://com/en/1", "http:///de/", "http://b.a.example.net?x"]
    urls += [r["url"] for r in rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    want = [plain_verdict(u, rules) for u in urls]
    for part in (urlfilter.RULES, 1, 3):
        monkeypatch.setattr(urlfilter, "RULES", part)
        got = sorted(rows(urlfilter.judge(df, rules)), key=lambda r: r["page_id"])
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == want
    assert rows(urlfilter.judge(df.limit(0), rules)) == []
    odd = spark.createDataFrame([(None, "http://a.com/en/1", "r", 1), (3, None, "s", 2), (3, None, "s", 2)], "page_id long, url string, _rank string, RANK int")
    assert sorted((r["_rank"], r["RANK"], r["verdict"]) for r in rows(urlfilter.judge(odd, rules))) == [("r", 1, "block"), ("s", 2, "allow"), ("s", 2, "allow")]


# ---------------------------------------------------------------- 10 near-duplicates


def plain_components(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and (both := len(sets[a] & sets[b])) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, seed, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = base[:]
        for _ in range(rng.randrange(6)):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, sf_dir, docs, odd_texts, percent, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in rows(documents(spark, sf_dir))}
    texts |= {10**6 + i: t for i, t in enumerate([*odd_texts, "A b C", "a B c", "x y z", *near_copies(60, 1), *near_copies(25, 2, 15)])}
    df = docs([(i, t, None, None) for i, t in texts.items()])
    want = plain_components(texts, percent)
    for bucket, group, shingles, few in ((neardup.BUCKET, neardup.GROUP, neardup.SHINGLES, neardup.FEW), (7, 5, 1500, 0)):  # small tiles: groups are dealt over many
        if percent == 80 and few == 0:
            continue
        for name, value in (("BUCKET", bucket), ("GROUP", group), ("SHINGLES", shingles), ("FEW", few)):
            monkeypatch.setattr(neardup, name, value)
        got = {r["doc_id"]: r for r in rows(neardup.near_duplicates(df, percent=percent))}
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    kept = {r["doc_id"] for r in rows(neardup.deduplicated(df, percent=percent))}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicate_odd_rows(spark, docs):
    df = docs([(None, "a b c d e f", None, None), (5, "a b c d e f", None, None), (5, "q r s t u v", None, None), (9, "q r s t u v", None, None), (None, "z", None, None), (7, None, None, None)])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(df))), key=repr)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (9, 5, False), (None, None, False), (7, 7, True)], key=repr)
    assert rows(neardup.near_duplicates(df.limit(0))) == []


def test_near_duplicates_of_null_and_repeated_ids(spark, docs):
    a, b, c = (near_copies(1, seed, 60)[0] for seed in (3, 4, 5))
    tail = lambda t, x: t.rsplit(" ", 1)[0] + f" {x}"
    head = lambda t, x: f"{x} " + t.split(" ", 1)[1]
    chain = [head(head(a, "p").replace("p ", "p q r s t u v w ", 1), "p"), a, a + " i j k l m n o"]  # the ends are linked through the middle alone
    table = [
        (20, chain[0]), (None, chain[1]), (21, chain[2]),  # a null id bridges
        (None, b), (None, tail(b, "x")), (None, tail(b, "x")),  # a component without an id
        (3, "k l m n o p"), (5, "k l m n o p"), (5, c), (9, c), (9, tail(c, "y")), (11, tail(c, "z")),  # ids join classes
        (30, "one row of two"), (30, "one row of two"), (None, ""), (None, None), (31, ""),
    ]
    want_sets = plain_components(dict(enumerate([chain[0], chain[2]])), 80)
    assert len({x for _, x in want_sets.values()}) == 2
    df = docs([(i, t, None, None) for i, t in table])
    got = [(r["doc_id"], r["component_id"]) for r in rows(neardup.near_duplicates(df))]
    want = [20, 20, 20, None, None, None, 3, 3, 3, 3, 3, 3, 30, 30, None, None, 31]
    assert sorted(got, key=repr) == sorted(((i, x) for (i, _), x in zip(table, want, strict=True)), key=repr)
    left = rows(neardup.deduplicated(df))
    assert sorted((r["doc_id"] for r in left if r["doc_id"] is not None)) == [3, 20, 30, 31]
    nameless = [r["text"] for r in left if r["doc_id"] is None]
    assert len(nameless) == 3 and sum(not t for t in nameless) == 2 and nameless.count(chain[1]) == 0


def test_large_groups_in_parts(spark, docs, monkeypatch):
    """One group whose links hold only through chains and several bodies: pivots settle some rows, chunks the rest."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    texts, now = [], base[:]
    for _ in range(70):  # a chain: each is near the one before, the ends are far apart
        now = now[:]
        for _ in range(3):
            now[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    for seed in range(12):  # copies of the base too far from each other, some with near copies of their own
        own = [w if rng.random() > 0.05 else f"u{rng.randrange(10**6)}" for w in base]
        texts += [" ".join(own), " ".join([*own[:-1], f"t{seed}"])]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    table = dict(zip(ids, texts, strict=True))
    want = plain_components(table, 85)
    monkeypatch.setattr(neardup, "GROUP", 6)
    monkeypatch.setattr(neardup, "BUCKET", 5)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    monkeypatch.setattr(neardup, "ROUNDS", 3)
    monkeypatch.setattr(neardup, "LEFT", 3)
    got = {r["doc_id"]: r["component_id"] for r in rows(neardup.near_duplicates(docs([(i, t, None, None) for i, t in table.items()]), percent=85))}
    assert got == {i: c for i, (_, c) in want.items()} and len(set(got.values())) > 3


def test_spanning_links_connect_what_hits_connect():
    rng = np.random.default_rng(2)
    for _ in range(60):
        hits = rng.random((6, 20)) < 0.12

        def parts(links):
            name = {}
            for a, b in links:
                x, y = name.get(a, {a}), name.get(b, {b})
                for z in (whole := x | y):
                    name[z] = whole
            return {frozenset(x) for x in name.values()}

        q, other = neardup.spanning(hits)
        got = parts([(("q", a), ("q", -1 - b) if b < 0 else ("r", b)) for a, b in zip(q.tolist(), other.tolist(), strict=True)])
        assert got == parts([(("q", a), ("r", b)) for a, b in zip(*(x.tolist() for x in np.nonzero(hits)), strict=True)])
        assert len(q) <= hits.any(axis=0).sum() + 6 * 20


def test_pivots_body():
    entry = lambda mask, body, n: {"mask": mask, "body": body, "n": n}
    groups = [[entry(1, False, 3), entry(6, False, 2), entry(2, False, 2)], [entry(1, False, 9), entry(2, True, 1), entry(6, False, 1)], [entry(1, False, 1)], [entry(3, False, 1), entry(6, True, 1), entry(8, False, 9)]]
    assert neardup._main(pa.array(groups)).to_pylist() == [6, 6, 1, 7]


def test_signature_guarantee():
    assert neardup.chunks_for(85) == 8 and neardup.chunks_for(80) == 11
    rng = np.random.default_rng(1)
    chunks = 8
    a = rng.integers(0, 1 << 16, 4 * chunks)
    for _ in range(200):
        b = a.copy()
        for i in rng.choice(4 * chunks, 2 * chunks - 1, replace=False):
            b[i] ^= 1 + rng.integers(0, 1000)
        assert any((a[c * 4 : c * 4 + 4] != b[c * 4 : c * 4 + 4]).sum() <= 1 for c in range(chunks))

"""The ten operators against plain Python on small awkward tables, and their invariants."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracefield.llm import bytesops, decontaminate, fm_index, language_id, lm_score, media, near_dup, packing, secret_scan, skew, substring_dedup, token_files, tokens, url_filter

from .conftest import odd_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BYTE, FOLD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def by_row(rows):
    """Rows as a multiset."""
    return Counter(map(tuple, rows))


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", [BYTE, FOLD])
def test_tokens_equal_the_librarys(path):
    rng = random.Random(11)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", ",", "#", "\u00a0", "1", "23", " ", "\u3000", "\u0301", "中", "=", "\u0338", "×", "\x85", "İ", "Σ", "ς", "🙂", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "the", "ﬁ", "\r\n", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [r[1] or "" for r in odd_texts()]
    ids, off = tokens.Encoder(path).encode(pa.array(texts))
    t = library(path)
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[off[i] : off[i + 1]].tolist(), texts[i]


SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>", "<|startoftext|>x <|endoftext|>", "x<|startoftext|>", "<|ENDOFTEXT|> <|endoftext", None, "", " <|endoftext|> "]


@pytest.mark.parametrize("path, end", [(BYTE, 2), (FOLD, 1)])
def test_special_tokens_are_encoded_as_the_library_does(spark, path, end, tmp_path):
    t = library(path)
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    ids = [t.encode(x or "", add_special_tokens=False).ids + [end] for x in SPECIAL]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_round_trip(docs, path, end, f"file://{tmp_path}").collect()}
    assert got == {i: (len(x), c) for i, (x, c) in enumerate(zip(ids, crc))}
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs, path, end).collect()}
    assert got == {i: (len(x), c) for i, (x, c) in enumerate(zip(ids, crc))}
    plain = library(path)
    plain.encode_special_tokens = True
    found, off = tokens.Encoder(path, ordinary=True).encode(pa.array(SPECIAL))
    assert [found[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [plain.encode(x or "", add_special_tokens=False).ids for x in SPECIAL]


def test_words_and_hashes():
    texts = [r[1] or "" for r in odd_texts()]
    data, off = bytesops.buffer(pa.array(texts))
    starts, ends, first = bytesops.words(data, off)
    raw = data.tobytes()
    found = [[raw[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert found == [WORD.findall(t) for t in texts]
    h = bytesops.span_hashes(data, starts, ends)
    assert len({x for t in found for x in t}) == len(set(h.tolist()))


def test_language_id(spark, odd, none, clashing):
    rng = random.Random(1)
    syllables = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ü", "ein"], "fr": ["eau", "é", "oi", "que"], "es": ["ción", "ñ", "ar", "os"]}
    rows = [(i, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(30)), k) for i, (k, s) in enumerate(list(syllables.items()) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(found) == len(rows)
    held = [(found[i]["lang_pred"], k) for i, _, k in rows if found[i]["held_out"]]
    assert held and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found.values())
    got = language_id.identify(odd).collect()
    assert len(got) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert language_id.identify(none).collect() == []
    assert language_id.identify(clashing).count() == odd.count()
    kept = language_id.keep_identified(clashing)
    assert kept.columns == clashing.columns
    assert {1, 2, 3}.isdisjoint(r["doc_id"] for r in kept.collect())


URLS = ["http://A.Net/x", "https://www.example.net/en/1?a=1", "https://example.net/en", "http://x.example.com/de/7", "http://x.example.com/fr/7", "http://org/fr/", "http://badorg/fr/1", "ftp://u.org/fr/a?b://c", "no scheme", "", None, "://", "http://EXAMPLE.com?x#y", "http://a.org/en/#z", "http://casino-win.example.com/en/1"]


def test_url_rules_and_trees(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 20)], "page_id long, url string, host string")
    model = url_filter.fit(pages.select("url", url_filter.seed_label(pages["url"]).alias("label")))
    got = {r["page_id"]: r for r in url_filter.judge(pages, model).collect()}
    for i, u in enumerate(URLS * 20):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            host, path = m[1].translate(LOWER), m[2]
        fits = [(len(t), v, t) for v, t in url_filter.RULES for n, s, p in [t.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith(s + p)]
        best = max(fits, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best[2] if best else None), u
        if best:
            assert got[i]["verdict"] == best[1]
        # The Column expression is the trees' sum, evaluated here by hand.
        x, margin = plain_features(u, model), model.prior
        for tree in model.trees:
            node = 1
            while node in tree.splits:
                name, cut = tree.splits[node]
                node = 2 * node + (x[name] > cut)
            margin += tree.values[node]
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-margin))) < 1e-9
        if not best:
            assert got[i]["verdict"] == ("block" if got[i]["score"] >= 0.5 else "allow")
    assert got[len(URLS) - 1]["verdict"] == "block" and got[4]["verdict"] == "allow"
    empty = pages.limit(0)
    assert url_filter.filter_urls(empty).collect() == []
    long = spark.createDataFrame([(1, "http://" + "a-" * 300_000 + "x/" + "b/" * 300_000, "x", 1), (1, "http://q.org/", "x", 1), (1, "http://q.org/", "x", 1), (None, None, None, None)], "page_id long, url string, score string, label int")
    got = url_filter.judge(long, model).collect()
    assert sorted(len(r["path"]) for r in got) == [0, 1, 1, 600_001] and len(got) == 4


def plain_features(url, model):
    """The features of a URL in plain Python; suffixes by the model's tables."""
    u = url or ""
    m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S) if "://" in u else None
    host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
    query = re.search(r"\?([^#]*)", u)
    query = query[1] if query else ""
    labels = [x for x in host.split(".") if x]
    shares = [n / len(host) for n in Counter(host).values()]
    out = {
        "length": len(u),
        "host_length": len(host),
        "path_length": len(path),
        "depth": len([x for x in path.split("/") if x]),
        "labels": len(labels),
        "hyphens": host.count("-"),
        "host_digits": sum(c in "0123456789" for c in host),
        "digit_ratio": sum(c in "0123456789" for c in u) / max(len(u), 1),
        "entropy": round(-sum(p * math.log2(p) for p in shares), 9),
        "parameters": query.count("&") + 1 if query else 0,
        "longest_label": max(map(len, host.split("."))),
    }
    for n, values in model.suffixes.items():
        suffix = ".".join(host.split(".")[-n:])
        signed = int(np.uint64(xxhash.xxh64_intdigest(suffix.encode(), seed=42)).astype(np.int64))
        out[f"suffix_{n}"] = values[signed % url_filter.SUFFIXES]
    return out


def auc(pairs):
    """The chance that a URL with label 1 has a greater score than one with label 0; ties count half."""
    rank, order = {}, sorted(s for s, _ in pairs)
    for k, s in enumerate(order):
        rank.setdefault(s, []).append(k + 1)
    ones = [s for s, y in pairs if y]
    n = len(pairs) - len(ones)
    return (sum(sum(rank[s]) / len(rank[s]) for s in ones) - len(ones) * (len(ones) + 1) / 2) / (len(ones) * n)


def test_trees_use_several_features_and_generalise_to_other_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", url_filter.seed_label(F.col("url")).alias("label"))
    out = F.pmod(F.xxhash64(url_filter.host_of(F.col("url"))), F.lit(3)) == 0
    model = url_filter.fit(pages.filter(~out))
    assert len(model.used()) > 1
    scores = {r["page_id"]: r["score"] for r in url_filter.judge(pages.filter(out), model, ()).collect()}
    labels = {r["page_id"]: r["label"] for r in pages.filter(out).collect()}
    assert 0 < sum(labels.values()) < len(labels)
    assert auc([(scores[i], y) for i, y in labels.items()]) > 0.95


def test_trees_find_what_takes_several_features(spark):
    """A label of which each feature alone tells little: digits in a deep path, or a long host with two parameters."""
    rng = random.Random(9)
    rows = []
    for _ in range(1500):
        host = "".join(rng.choice("abcdefghij") for _ in range(rng.choice([5, 30])))
        parts = ["".join(rng.choice("0123456789" if digits else "abcdef") for _ in range(6)) for _ in range(rng.randint(1, 5)) for digits in [rng.random() < 0.5]]
        query = rng.choice(["", "?a=1", "?a=1&b=2"])
        digits = sum(c.isdigit() for c in "".join(parts)) / 6
        rows.append((f"http://{host}.example.org/{'/'.join(parts)}{query}", int((len(parts) > 3 and digits >= 2) or (len(host) > 10 and "&" in query))))
    urls = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, label int")
    model = url_filter.fit(urls.filter("page_id < 1000").select("url", "label"))
    scores = {r["page_id"]: r["score"] for r in url_filter.judge(urls.filter("page_id >= 1000"), model, ()).collect()}
    assert len(model.used()) >= 3
    assert auc([(s, rows[i][1]) for i, s in scores.items()]) > 0.95


def test_trees_separate_what_a_feature_separates(spark):
    rows = [(f"http://{'a' * (i % 9 + 3)}{'-x' * (i % 3 == 0)}.example.com/{i}", int(i % 3 == 0)) for i in range(300)]
    urls = spark.createDataFrame(rows, "url string, label int")
    model = url_filter.fit(urls)
    pages = urls.selectExpr("cast(label as long) as page_id", "url")
    assert all((r["score"] > 0.5) == bool(r["page_id"]) for r in url_filter.judge(pages, model, ()).collect())


def test_base_scores_and_model(spark, odd, none, clashing):
    got = lm_score.score(odd).collect()
    rows = odd_texts()
    counts, out = Counter(), {}
    for i, t, *_ in rows:
        if zlib.crc32(str(i if i is not None else "").encode()) % 10:
            counts.update([*WORD.findall((t or "").translate(LOWER)), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, t, *_ in rows:
        w = [*WORD.findall((t or "").translate(LOWER)), None]
        expected.append((i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    assert by_row((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == by_row(expected)
    assert all(r["score"] < 0 for r in got)
    assert lm_score.score(none).collect() == []
    assert lm_score.score(clashing).count() == len(rows)
    del out


def counts_of(keys, times):
    short = lm_score._summed(lm_score.short_of(keys), times)
    return lm_score.counted(keys, times, lm_score.short_counts(*short))


def test_model_is_a_distribution_and_learns():
    """Over all 256 symbols in one context the probabilities add up to one."""
    text = pa.array(["the cat sat on the mat. " * 200])
    keys, times = lm_score.events(*bytesops.buffer(text))
    assert times.sum() == 24 * 200 + 1
    context = (keys[5] >> np.uint64(8)) << np.uint64(8)
    every = context + np.arange(256, dtype=np.uint64)
    union, weight = lm_score._summed(np.concatenate([keys, every]), np.concatenate([times, np.zeros(256, np.int64)]))
    table = counts_of(union, weight)
    mixer = lm_score.Mixer.new()
    before = (lm_score.bits_of(table, mixer, union) * weight).sum()
    for _ in range(10):
        lm_score.learn(table, mixer, union, weight.astype(float), True)
    assert (lm_score.bits_of(table, mixer, union) * weight).sum() < min(before, weight.sum())
    cost = lm_score.bits_of(table, mixer, union)[np.searchsorted(union, every)]
    assert abs((2.0**-cost).sum() - 1) < 1 / lm_score.FINE


class PlainMixer:
    """The model in plain Python, bit by bit: counts in dictionaries, weights in lists."""

    def __init__(self, training):
        self.n, self.one = Counter(), Counter()
        for context, symbol, times in training:
            for bit in range(8):
                for k in lm_score.CONTEXT:
                    at = (k, context[6 - k :], (256 + symbol) >> (8 - bit))
                    self.n[at] += times
                    self.one[at] += times * (symbol >> (7 - bit) & 1)
        self.weights = {}
        self.refined = {}

    def look(self, context, symbol, bit, own):
        y, node = symbol >> (7 - bit) & 1, (256 + symbol) >> (8 - bit)
        x, seen = [], []
        for k in lm_score.CONTEXT:
            n, one = self.n[k, context[6 - k :], node], self.one[k, context[6 - k :], node]
            if own:
                n, one = max(n - 1, 0), max(one - y, 0)
            x.append(math.log((one + 0.3) / (max(n - one, 0) + 0.3)))
            seen.append((n > 0) + (n > 2) + (n > 12))
        which = (seen[-1] * 4 + seen[-2]) * 8 + bit
        x.append(0.3)
        z = sum(a * b for a, b in zip(self.weights.get(which, [0.3] * 6 + [0.0]), x))
        place = (node, min(max(int((z + 12) * (lm_score.BUCKETS / 24)) if z + 12 >= 0 else 0, 0), lm_score.BUCKETS - 1))
        return y, x, which, z, place

    def learn(self, buckets):
        total, seen = Counter(), Counter()
        for events in buckets:  # (context, symbol, times) in the order of their keys
            self.weights = {}
            own_seen = Counter()
            for part in range(lm_score.STEPS):
                for bit in range(8):
                    g, h = Counter(), Counter()
                    for context, symbol, times in events[part :: lm_score.STEPS]:
                        y, x, which, z, place = self.look(context, symbol, bit, True)
                        p = 1 / (1 + math.exp(-min(max(z, -20), 20)))
                        own_seen[which] += times
                        for k, v in enumerate(x):
                            g[which, k] += (y - p) * times * v
                            h[which, k] += (p * (1 - p) + 1e-3) * times * v * v
                        if part >= lm_score.STEPS // 2:
                            r = self.refined.setdefault(place, [0, 0])
                            r[0] += y * times
                            r[1] += times
                    for which, k in g:
                        w = self.weights.setdefault(which, [0.3] * 6 + [0.0])
                        w[k] += min(max(lm_score.RATE * g[which, k] / (h[which, k] + 20), -0.3), 0.3)
            for which, n in own_seen.items():
                seen[which] += n
                for k in range(7):
                    total[which, k] += round(self.weights[which][k] * lm_score.GRAIN) * n
        self.weights = {w: [total[w, k] / seen[w] / lm_score.GRAIN for k in range(7)] for w in seen}

    def bits(self, context, symbol):
        out = 0.0
        for bit in range(8):
            y, _, _, z, place = self.look(context, symbol, bit, False)
            p = 1 / (1 + math.exp(-min(max(z, -20), 20)))
            one, n = self.refined.get(place, (0, 0))
            p = min(max(0.5 * p + 0.5 * (one + 2 * p) / (n + 2), 1e-6), 1 - 1e-6)
            out -= math.log2(p if y else 1 - p)
        return out


def test_scores_equal_a_plain_model_and_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(40)] + [(40, None), (41, ""), (3, "abc"), (3, "abc")]
    one_key = lambda c, s: int.from_bytes(c[::-1] + bytes([s]), "big")
    events, per_row = Counter(), []
    for i, t in rows:
        raw = b"\0" * 6 + (t or "").encode() + b"\xff"
        own = [(raw[k - 6 : k], raw[k]) for k in range(6, len(raw))]
        per_row.append(own)
        if zlib.crc32(str(i).encode()) % 10:
            events.update(own)
    buckets = {}
    for (c, s), n in events.items():
        key = one_key(c, s)
        buckets.setdefault(int(lm_score._bucket_of(np.array([key], np.uint64), 16)[0]), []).append((key, c, s, n))
    plain = PlainMixer([(c, s, n) for (c, s), n in events.items()])
    plain.learn([[x[1:] for x in sorted(b)] for b in buckets.values()])
    expected = sorted((i, round(sum(plain.bits(c, s) for c, s in own), 1)) for (i, _), own in zip(rows, per_row))
    found = []
    for parts in (1, 4, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, F.xxhash64("doc_id", "text"))
        found.append(sorted((r["doc_id"], r["bits"], r["score"], r["base_score"], r["bits_per_byte"]) for r in lm_score.score(docs).collect()))
    assert found[0] == found[1] == found[2]
    for (i, bits), (j, got, score, _, per_byte) in zip(expected, found[0]):
        assert i == j and abs(bits - got) <= 0.1 + 2e-3 * bits and abs(score + got * math.log10(2)) < 1e-9
    assert {i: round(b / x, 9) for i, b, _, _, x in found[0] if i == 41} == {41: 1.0}


def shingle_sets(rows):
    out = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def test_keys_are_the_bytes_before_a_symbol():
    texts = [r[1] or "" for r in odd_texts()[:9]] + ["", "ab", "abcdefghé"]
    expected, ends = [], []
    for t in texts:
        raw = b"\0" * 6 + t.encode() + b"\xff"
        keys = [int.from_bytes(raw[k - 6 : k][::-1] + raw[k : k + 1], "big") for k in range(6, len(raw))]
        expected += keys[:-1]
        ends.append(keys[-1])
    assert lm_score.symbols(*bytesops.buffer(pa.array(texts))).tolist() == expected + ends


def test_context_counts_are_exact():
    """No counter is shared: each order's counts are those of the contexts themselves, however many there are."""
    rng = np.random.default_rng(3)
    texts = pa.array(["".join(map(chr, rng.integers(97, 123, 40000))) for _ in range(3)])
    keys, times = lm_score.events(*bytesops.buffer(texts))
    known = counts_of(keys, times)
    for k, size in enumerate(lm_score.CONTEXT):
        for bit in (0, 4, 8):
            name = [(x >> 8 * (7 - size), (x & 255) >> (8 - bit)) for x in keys.tolist()]
            n = Counter()
            for x, c in zip(name, times.tolist()):
                n[x] += c
            assert known.depths[k, bit].tolist() == [n[x] for x in name]


def test_the_longest_context_has_six_bytes():
    one, other = (lm_score.symbols(*bytesops.buffer(pa.array([x])))[6] for x in ("a12345x", "b12345x"))
    assert one != other
    names = [lm_score._of_order(np.array([x]), lm_score.ORDERS - 1)[0] for x in (one, other)]
    assert names[0] != names[1]


def brute_groups(rows, percent):
    sets = [(i, s) for i, s in shingle_sets(rows) if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize("threshold", [0.85, 0.8])
def test_near_duplicates(spark, odd, none, clashing, threshold):
    rows = odd_texts()
    groups = brute_groups(rows, round(100 * threshold))
    expected = by_row((i, len(s), groups.get(i)) for i, s in shingle_sets(rows) if i is not None)
    for table in (odd, clashing):
        got = near_dup.near_duplicates(table, threshold).collect()
        assert by_row((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == expected
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
        assert len(got) == len(rows)
    assert near_dup.near_duplicates(none, threshold).collect() == []


def test_a_chain_of_near_copies_and_small_blocks(spark, monkeypatch):
    """Each copy differs a little from the one before: one component by links alone, in blocks of three members too."""
    rng = random.Random(5)
    words = [str(rng.randrange(10**6)) for _ in range(200)]
    rows = []
    for k in range(24):
        rows.append((k, " ".join(words)))
        words = list(words)
        words[(k * 37) % 200] = f"new{k}"
    rows += [(100 + k, " ".join(str(rng.randrange(10**6)) for _ in range(200))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_groups(rows, 85)
    assert len(set(expected.values())) == 6
    for block in (near_dup.BLOCK, 3):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 0.85).collect()} == expected


def test_isolated_pairs_near_the_threshold_are_linked(spark):
    rng = random.Random(12)
    rows = []
    for k in range(6000):
        words = [f"{rng.getrandbits(40):x}" for _ in range(rng.randint(70, 74))]
        rows.append((2 * k, " ".join(words)))
        words[rng.randint(4, len(words) - 5)] = "changed"  # 5 of at least 66 shingles go: similarity 0.859 to 0.867
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 0.85).collect()}
    assert [d for d in found if found[d] != d // 2 * 2] == []


def test_bounds_drop_few_pairs():
    need = near_dup.least_matches(0.85)
    rng = np.random.default_rng(0)
    m = (rng.random((20000, near_dup.BANDS * near_dup.ROWS)) < 0.85).cumsum(1)
    at = range(near_dup.STEP, near_dup.BANDS * near_dup.ROWS + 1, near_dup.STEP)
    assert np.mean(np.any([m[:, n - 1] < need[n] for n in at], axis=0)) < 0.001
    assert need[-1] > 0.6 * near_dup.BANDS * near_dup.ROWS


def test_token_files(spark, odd, none, clashing, tmp_path):
    t = library(BYTE)
    rows = sorted(odd_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, expected = 0, []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for k, table in enumerate((odd, clashing)):
        folder = f"file://{tmp_path}/{k}"
        got = token_files.token_file_round_trip(table, BYTE, 2, folder)
        assert by_row(got.collect()) == by_row(expected)
    values, mask = token_files.sequence_at(f"file://{tmp_path}/0", 0, 0)
    assert len(values) == token_files.SEQUENCE and mask.sum() == min(start, token_files.SEQUENCE)
    assert token_files.token_file_round_trip(none, BYTE).collect() == []


def test_media(spark, odd, none, clashing):
    expected = []
    for i, text, *_ in odd_texts():
        raw = (text or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        png = media.encode_png(p)
        assert media.decode_png(png).tobytes() == p
        expected.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(png), hashlib.sha256(png).hexdigest()))
    for table in (odd, clashing):
        assert by_row(tuple(r)[:7] for r in media.round_trip(table).collect()) == by_row(expected)
    assert media.round_trip(none).collect() == []


def test_interleaving_keeps_places_and_captions(spark):
    html = '<p>one <b>two</b></p><script>x</script><figure><img src="sha256:aa"><img src="b.png" alt="z"><figcaption>both &amp; more</figcaption></figure>tail<img src="sha256:cc" alt="own"><p>end'
    items = media.parse_html(html)
    assert [(x["position"], x["kind"], x["text"], x["ref"], x["caption"]) for x in items] == [
        (0, "text", "one two", None, None),
        (1, "media", None, "aa", "both & more"),
        (2, "media", None, "b.png", "both & more"),
        (3, "text", "tail", None, None),
        (4, "media", None, "cc", "own"),
        (5, "text", "end", None, None),
    ]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    payloads = spark.createDataFrame([("aa", 7)], "digest string, size int")
    got = sorted(media.resolve(media.interleave(pages), payloads).collect(), key=lambda r: r["position"])
    assert [r["size"] for r in got] == [None, 7, None, None, None, None]


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, odd, none, clashing):
    expected = []
    for i, text, *_ in odd_texts():
        s = brute_secrets(text or "")
        joined = ",".join(f"{k}:{a}:{e}" for a, _, k, e in s)
        expected.append((i, *(sum(x[2] == k for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest(), joined))
    for table in (odd, clashing):
        assert by_row(secret_scan.scan(table).collect()) == by_row(expected)
    assert secret_scan.scan(none).collect() == []


def test_ledger_scans_what_is_new(spark, odd):
    ledger = secret_scan.new_ledger(spark)
    rows = lambda: spark.read.parquet(ledger).count()
    secret_scan.update_ledger(odd.filter("doc_id < 8"), ledger)
    some = rows()
    secret_scan.update_ledger(odd, ledger)
    whole = rows()
    secret_scan.update_ledger(odd, ledger)
    assert some < whole == rows() == odd.selectExpr("coalesce(text, '')").distinct().count()
    secret_scan.update_ledger(odd, ledger, version="next")
    assert rows() == 2 * whole


def test_redaction(spark, odd, clashing):
    out = secret_scan.redact(clashing)
    assert out.columns == clashing.columns
    for r in out.collect():
        assert not brute_secrets(r["text"] or "")
    text = "a token=abcdefgh b 0123456789abcdef01234567 c"
    got = secret_scan.redact(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")).first()
    assert (got["text"], got["n_chars"]) == ("a [SECRET] b [SECRET] c", 23)


def brute_repeats(rows):
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    n = substring_dedup.WINDOW
    seen = Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def test_substring_dedup(spark, odd, none, clashing, monkeypatch):
    expected = by_row(brute_repeats(odd_texts()))
    for table in (odd, clashing):
        assert by_row(substring_dedup.remove_repeats(table).collect()) == expected
    monkeypatch.setattr(substring_dedup, "CROWDED", 1)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 100)
    assert by_row(substring_dedup.remove_repeats(odd).collect()) == expected
    assert substring_dedup.remove_repeats(none).collect() == []


def test_bit_vectors_and_hot_keys(spark):
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 5000):
        for share in (0, 0.002, 0.5, 1):
            bits = (rng.random(n) < share).astype(np.uint8)
            assert (fm_index.BitVector(bits).rank(np.arange(n + 1)) == np.r_[0, np.cumsum(bits)]).all()
    assert fm_index.BitVector(np.zeros(1 << 16, np.uint8)).nbytes < (1 << 16) / 8 / 3
    many = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(100, 9000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 0)], "k long, v long"))
    assert len(skew.hot_keys(many, F.xxhash64("k"))) == 1
    for how in ("inner", "left"):
        assert by_row(skew.join_one(many, one, ["k"], how).collect()) == by_row(many.join(one, "k", how).collect())


def test_fm_index_counts():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 400)
    index = fm_index.FMIndex(text, 16)
    s = text.tolist()
    ends = np.arange(1, 401)
    got = index.matching_lengths(text, ends, np.minimum(ends, 12))
    for e, g in zip(ends.tolist(), got.tolist()):
        best = 0
        for n in range(1, min(e, 12) + 1):
            p = s[e - n : e]
            if sum(s[k : k + n] == p for k in range(401 - n)) < 2:
                break
            best = n
        assert g == best


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return min(row), row.index(min(row))


def test_myers():
    rng = random.Random(4)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab é") for _ in range(rng.randint(1, n))) for n in (14, 40))
        assert decontaminate.Myers(p).best(t) == edit_distance(p, t)


def test_decontamination(spark, none, clashing):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)] + [(6, None), (7, ""), (8, "tiny one")]
    rows = [(1, None), (2, ""), (3, " ".join(word() for _ in range(500))), (4, "so tiny  ONE here"), (5, "tiny ones")]
    for k in range(6):
        chars = list(items[k][1])
        for _ in range(k * 2):  # edits, some more than allowed
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["z"], [chars[at], "y"]])
        rows.append((10 + k, word() + " " + "".join(chars).upper().replace(" ", "\n") + " " + word()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for i, t in rows:
        folded = decontaminate.folded(t)
        for k, item in items:
            p = decontaminate.folded(item)
            if not p:
                continue
            if len(p) < decontaminate.SHORT:
                if f" {p} " in f" {folded} ":
                    expected.add((i, k, 0))
            elif folded and (d := edit_distance(p, folded)[0]) <= decontaminate.allowed_errors(p):
                expected.add((i, k, d))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert got == expected and len(got) >= 4
    assert decontaminate.find_items(none, bench).collect() == []
    assert decontaminate.find_items(docs, bench.limit(0)).collect() == []
    assert decontaminate.remove_contaminated(clashing, bench).columns == clashing.columns


def brute_bins(lengths, limit):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(limit - n)
    return len(rooms)


def test_best_fit_equals_one_by_one():
    rng = random.Random(6)
    for _ in range(150):
        limit = rng.choice([5, 16, 50])
        lengths = [rng.randint(1, limit) for _ in range(rng.randint(0, 100))]
        assert packing.best_fit(dict(Counter(lengths)), limit)[1] == brute_bins(lengths, limit)


def test_packing(spark, odd, none, clashing):
    t = library(FOLD)
    limit = 256
    expected = []
    for i, text, *_ in odd_texts():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            expected.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    for table in (odd, clashing):
        got = packing.pack_documents(table, FOLD, 1, limit).collect()
        assert by_row(tuple(r)[:5] for r in got) == by_row(expected)
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= limit
        assert len(bins) == brute_bins([r["length"] for r in got], limit)
    assert packing.pack_documents(none, FOLD).collect() == []


def test_language_accuracy_on_rows_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r["doc_id"]: r["lang"] for r in docs.filter("lang is not null").select("doc_id", "lang").collect()}
    pairs = [(r["lang_pred"], known[r["doc_id"]]) for r in language_id.identify(docs).filter("held_out and lang_pred <> 'und'").collect() if r["doc_id"] in known]
    assert len(pairs) > 100 and sum(a == b for a, b in pairs) / len(pairs) > 0.97


def test_hidden_elements_without_content_hide_nothing():
    for tag in ("template", "script", "style", "noscript"):
        items = media.parse_html(f"<p>a</p><{tag}/><p>kept text</p><{tag}>gone</{tag}>end")
        assert [x["text"] for x in items] == ["a", "kept text", "end"]


def test_findings_are_one_for_a_blob(spark, odd):
    ledger = secret_scan.new_ledger(spark)
    secret_scan.update_ledger(odd, ledger)
    spark.read.parquet(ledger).limit(100).write.mode("append").parquet(ledger)  # as if two scans had run at a time
    assert secret_scan.findings(odd, ledger).count() == odd.count()


def test_texts_beyond_one_slice(spark):
    """Texts that make slices of their own, between short ones; two share a passage and one is there twice."""
    rng = random.Random(21)
    voc = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(30000)]
    text = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    passage, item = text(60), text(40)
    rows = [(1, text(5)), (2, text(230_000) + " " + passage + " password=abcdefgh é"), (3, ""), (4, passage), (5, text(1000) + " " + item), (6, None), (7, text(240_000) + " " + item)]
    rows.append((8, rows[1][1]))
    assert len(rows[1][1]) > bytesops.SLICE
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t, fold = library(BYTE), library(FOLD)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in rows}
    assert {r["doc_id"]: r["ids_crc32"] for r in token_files.token_file_round_trip(docs, BYTE, 2).collect()} == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in ids.items()}
    pieces = packing.pack_documents(docs, FOLD).collect()
    for i, x in rows:
        own = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["piece"])
        whole = fold.encode(x or "", add_special_tokens=False).ids + [1]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(whole[a : a + 4096], "<u4").tobytes()) for a in range(0, len(whole), 4096)]
    groups = brute_groups(rows, 85)
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 0.85).collect()} == groups and groups[8] == 2
    assert by_row(substring_dedup.remove_repeats(docs).collect()) == by_row(brute_repeats(rows))
    for r in media.round_trip(docs).collect():
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        assert r["payload_sha256"] == hashlib.sha256(raw + b"\xff" * (-len(raw) % 576 if raw else 576)).hexdigest()
    assert {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs).collect()} == {i: ",".join(f"{k}:{a}:{e}" for a, _, k, e in brute_secrets(x or "")) for i, x in rows}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find_items(docs, bench).collect()} == {5, 7}
    scored = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    assert all(scored[i]["n_tokens"] == len(WORD.findall(x or "")) + 1 for i, x in rows) and scored[2]["score"] == scored[8]["score"]
    assert len(language_id.identify(docs.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'en', 'de') as lang")).collect()) == len(rows)


def test_repeated_rows_in_url_filter_and_decontamination(spark, odd):
    twice = spark.createDataFrame([(1, "http://a-b.org/?x=1", "v", "w"), (1, "http://a-b.org/?x=1", "v", "w")], "page_id long, url string, score string, x_length string")
    got = url_filter.filter_urls(twice).collect()
    assert len(got) == 2 and got[0] == got[1]
    bench = odd.filter("doc_id = 4").limit(1).selectExpr("7L as item_id", "text")
    found = decontaminate.find_items(odd, bench).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in found}[4] == 2

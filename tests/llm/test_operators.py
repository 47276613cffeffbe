"""Operators on training data against brute force, and their defined results on odd tables."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, exact_dedup, mixing, near_dedup, packing, pii, quality, substring_dedup, textkit, token_counts, url_rules
from maskwright.llm.tokenizers_io import Encoder

tokenizers = pytest.importorskip("public_tokenizers")
BPE = tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts)], DOCS).repartition(parts)


def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
    texts = [None, "", " \t\n", "one two", "one two", long, long, "a b c d e f g", "A b\nc d e f g", None, "ünïcode 日本語 text"]
    ids = [0, 1, 2, 3, 3, 5, 6, 7, 8, None, 10]
    df = docs(spark, texts, ids)
    for clash in ("score", "key", "n", "id", "label", "posterior", "rate", "component", "digest", "t", "words"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


WORDS = [f"{a}{b}" for a in ("ta", "ko", "mi", "re", "su", "no") for b in ("la", "ni", "po", "ter", "x", "gam", "du", "eth")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


# --- words and shingles


def plain_words(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]


def test_words_and_shingles():
    texts = ["One two  THREE four five six", "", None, "a", "x y", " \n", "É é İ a b c", "one two three four five", "a\x0bb\x1cc\u00a0d e"]
    seen, sets = {}, []
    for w in textkit.words(pa.array(texts), slice_bytes=16):
        values, bounds = textkit.shingles(w)
        for d in range(len(w)):
            mine = plain_words(texts[w.first + d])
            assert [bytes(w.data[a:b]).lower() for a, b in zip(w.start[w.bound[d] : w.bound[d + 1]], w.end[w.bound[d] : w.bound[d + 1]])] == mine
            for word, h in zip(mine, w.hash[w.bound[d] : w.bound[d + 1]]):
                assert seen.setdefault(word, h) == h
            grams = [tuple(mine[i : i + 5]) for i in range(len(mine) - 4)] or ([tuple(mine)] if mine else [])
            own = values[bounds[d] : bounds[d + 1]]
            assert len(own) == len(grams)
            sets.append(dict(zip(grams, own)))
    assert len(set(seen.values())) == len(seen)
    merged = {}
    for s in sets:
        for g, h in s.items():
            assert merged.setdefault(g, h) == h
    assert len(set(merged.values())) == len(merged)


# --- 2 exact dedup


def test_trie_spills_and_merges():
    trie, r = exact_dedup.PatriciaTrie(), random.Random(4)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randrange(6))) for _ in range(400)]
    spilled = []
    for i, k in enumerate(keys):
        trie.insert(k, i, 1, None)
        if i % 90 == 89 and trie.weight:
            spilled += list(trie.spill())
    got = collections.defaultdict(lambda: [10**9, 0])
    for k, p in [*spilled, *trie.drain()]:
        got[k] = [min(got[k][0], p[0]), got[k][1] + p[1]]
    assert got == {k: [keys.index(k), keys.count(k)] for k in set(keys)}


@pytest.mark.parametrize("budget", [1, 10_000, exact_dedup.BUDGET_BYTES])
def test_exact_groups(spark, budget):
    r = random.Random(1)
    texts = [r.choice(["same  text", "same text", "other", "", None, "x" * r.randrange(5)]) for _ in range(200)]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    rows = {x["doc_id"]: x for x in exact_dedup.exact_groups(docs(spark, texts, parts=5), budget_bytes=budget).collect()}
    for i, t in enumerate(norm):
        x = rows[i]
        assert (x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) == (norm.index(t), norm.count(t), norm.index(t) == i, hashlib.sha256(t.encode()).hexdigest())


def test_exact_odd(spark):
    rows = exact_dedup.exact_groups(odd(spark)).collect()
    assert len(rows) == 11 and next(x for x in rows if x["doc_id"] is None)["keep_id"] == 0
    assert [x["kept"] for x in rows if x["doc_id"] == 3] == [True, True] and not next(x for x in rows if x["doc_id"] == 8)["kept"] is None
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


# --- 9 and 3 tokens


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def huge():
    r = random.Random(5)
    parts = [prose(3000, 1), "<|endoftext|>", "字" * 5000, " \n" * 3000, prose(500, 2), "y" * 9000, "it's <|endof text|> " * 500, "é ü " * 4000]
    return [" ".join(r.sample(parts, len(parts))) for _ in range(4)] + ["z" * 90_000, " " * 50_000]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (1000, 16), (32768, 1024)])
def test_spliced_ids(chunk, overlap):
    enc, lib = Encoder(BPE), library()
    for t in huge()[:2] if chunk < 100 else huge():
        t = t[:6000] if chunk < 100 else t
        assert token_counts.spliced_ids(enc, t.encode(), chunk, overlap).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_other_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    text = "Hello   wörld <|endoftext|> 12"
    word = tokenizers.path("word_bpe_49k.json")
    assert Encoder(word).encode(text).tolist() == Tokenizer.from_file(word).encode(text, add_special_tokens=False).ids
    piece = tokenizers.path("piece_bpe_32k.model")
    assert Encoder(piece).encode(text).tolist() == sentencepiece.SentencePieceProcessor(model_file=piece).encode(text)


def test_count_tokens(spark):
    lib, texts = library(), [*huge(), prose(50, 3), "", None, "<|endoftext|>", "don't", prose(50, 3)]
    rows = {x["doc_id"]: x for x in token_counts.count_tokens(docs(spark, texts), BPE, chunk=2000, overlap=32).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert token_counts.count_tokens(odd(spark), BPE).count() == 11 and token_counts.count_tokens(docs(spark, []), BPE).count() == 0


def test_best_fit():
    r = np.random.default_rng(2)
    for length in (8, 37, 64):
        sizes = r.integers(1, length + 1, 300)
        rows = packing.best_fit_decreasing(sizes, length)
        rooms, want = [], []
        for p in np.argsort(-sizes, kind="stable"):
            fits = [k for k, room in enumerate(rooms) if room >= sizes[p]]
            k = min(fits, key=lambda k: rooms[k]) if fits else len(rooms)
            if not fits:
                rooms.append(length)
            rooms[k] -= sizes[p]
        assert sorted(sum(rows, [])) == list(range(300)) and all(sizes[row].sum() <= length for row in rows) and len(rows) == len(rooms)


def test_packing_loses_nothing(spark):
    lib, texts = library(), [prose(n, n) for n in (1, 5, 40, 300, 1200)] + ["", None] + huge()[:1]
    out = packing.pack_tokens(docs(spark, texts), BPE, length=128, block_tokens=2000).collect()
    got = collections.defaultdict(dict)
    for r in out:
        ids, cu = np.frombuffer(r["ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 128 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 128 and r["position_resets"] == cu[:-1] and not ids[cu[-1] :].any()
        assert packing.position_ids(cu, 128)[cu[:-1]].tolist() == [0] * (len(cu) - 1)
        for s, (d, p, a) in enumerate(zip(r["doc_ids"], r["pieces"], r["token_starts"])):
            got[d][p] = ids[cu[s] : cu[s + 1]].tolist()
            assert a == 128 * p
    assert len({r["row_id"] for r in out}) == len(out)
    for i, t in enumerate(texts):
        assert sum((got[i][p] for p in sorted(got[i])), []) == lib.encode(t or "", add_special_tokens=False).ids
    assert packing.pack_tokens(docs(spark, []), BPE).count() == 0 and packing.pack_tokens(odd(spark), BPE).count() > 0


# --- 8 personal data


def plain_spans(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans():
    r = random.Random(6)
    bits = ["a", "@", ".", "b.c", "1", "23", "255", "4", "+", " ", "-", "(", ")", "é", "4111 1111 1111 1111", "\n", "_%", "10.0.0.1", "x@y.zz", "+1 (375) 555-4393"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_learnt_spans(spark):
    r = random.Random(7)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = [f"please use tel: +49 {digits(3)} {digits(6)} thanks the {digits(4)}" for _ in range(40)]
    texts += [f"please use tel: {digits(11)} thanks" for _ in range(3)] + [f"the year {digits(4)} and the number {digits(11)} of it" for _ in range(40)] + [prose(30, 9)]
    got = {x["doc_id"]: x for x in pii.personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in plain_spans(t)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and got[i]["n_phone"] == sum(b.startswith("phone") for b in base)
        assert set(base) <= set(got[i]["spans"].split(","))
        assert (got[i]["n_learnt"] > 0) == (40 <= i < 43), (i, got[i])
    assert pii.personal_data(odd(spark)).count() == 11 and pii.personal_data(docs(spark, [])).count() == 0


def test_learnt_spans_in_groups_and_brackets(spark):
    r = random.Random(17)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts = [f"please use tel: (+49 {digits(3)} {digits(6)}) thanks; mail: <{'xyz'[i % 3]}{i}@some.org> of us" for i in range(40)]
    hidden = ["089 123 4567", "(089) 123 4567", "089 / 1234567", "(0891234567)"]
    texts += [f"please use tel: {h} at once" for h in hidden] + ["then mail: <someone@localhost> at once", "in 2004 12 men"]
    got = {x["doc_id"]: x for x in pii.personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts[40:45]):
        value = ("089 123 4567", "089) 123 4567", "089 / 1234567", "0891234567", "someone@localhost")[i]
        start = t.index(value)
        assert got[40 + i]["spans"] == f"{'phone' if i < 4 else 'email'}:{start}:{start + len(value)}", (t, got[40 + i])
    assert got[45]["n_learnt"] == 0


def plain_learnt(texts, rounds=3, min_seeds=3, accept=0.8):
    """Spans of every text by the formulas of the module, from dictionaries of word tuples."""
    occ = [pii.occurrences(t or "", pii.base_spans(t or "")) for t in texts]
    uses = collections.Counter()
    for t in texts:
        w = plain_words(t)
        for n in (1, 2, 3):
            uses.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    fold = lambda ws: tuple(x.encode().lower() if x.isascii() else re.sub(rb"[A-Z]", lambda m: m.group().lower(), x.encode()) for x in ws)
    edges, kind_of, bar = collections.Counter(), {}, {}
    for t, some in zip(texts, occ):
        for a, b, k, left, right, shape in some:
            v = t[a:b]
            keys = [("<", fold(left[:n][::-1])) for n in range(1, len(left) + 1)] + [(">", fold(right[:n])) for n in range(1, len(right) + 1)] + [("=", pii.form(v))]
            for side, word in keys:
                edges[side, word, shape, v] += 1
            kind_of[v], bar[v] = max(k, kind_of.get(v, -1)), pii.barred(v)
    patterns = collections.defaultdict(dict)
    for (side, word, shape, v), n in edges.items():
        patterns[side, word, shape][v] = n
    patterns = {p: vs for p, vs in patterns.items() if len(vs) >= min_seeds}
    near = collections.Counter()
    for (side, word, _), vs in patterns.items():
        near[side, word] += sum(vs.values())
    with_pattern = {v for vs in patterns.values() for v in vs}
    seeds = {(v, k): 1.0 for v, k in kind_of.items() if k >= 0 and v in with_pattern}
    scores = seeds
    for _ in range(rounds):
        sides = collections.defaultdict(float)
        for (side, word, shape), vs in patterns.items():
            special = 1.0 if side == "=" else min(1.0, near[side, word] / uses[word])
            for k in range(5):
                if sum(scores.get((v, k), 0) >= accept for v in vs) < min_seeds:
                    continue
                c = sum(n * scores.get((v, k), 0) for v, n in vs.items()) / (sum(vs.values()) + 2) * special
                for v in vs:
                    if c >= 0.05 and kind_of[v] < 0 and bar[v] != k:
                        sides[v, k, side] = max(sides[v, k, side], c)
        learnt = collections.defaultdict(lambda: 1.0)
        for (v, k, _), c in sides.items():
            learnt[v, k] *= 1 - min(c, 0.999)
        scores = seeds | {x: 1 - p for x, p in learnt.items()}
    best = {}
    for (v, k), x in scores.items():
        if x >= accept and (v not in best or (x, -k) > best[v]):
            best[v] = (x, -k)
    out = []
    for t, some in zip(texts, occ):
        fresh = [(a, b, -best[t[a:b]][1]) for a, b, k, *_ in some if k < 0 and t[a:b] in best]
        fresh = [(a, b, k) for a, b, k in fresh if not any(s <= a and e >= b and e - s > b - a for s, e, _ in fresh)]
        every = [(a, b, k) for a, b, k, *_ in some if k >= 0] + fresh
        out.append(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in sorted(every, key=lambda x: (x[0], x[2]))))
    return out


def test_scoring_rounds(spark):
    """All spans against the plain formulas, on texts of its own and on a whole given table."""
    r = random.Random(23)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    cues = ["tel:", "call us at", "fax", "Kundennummer", "ref no", "the"]
    texts = [f"{r.choice(cues)} {r.choice(['+49 %s %s' % (digits(3), digits(6)), digits(11), '(%s) %s' % (digits(3), digits(7)), '4111111111111111', digits(16)])} {r.choice(['now', 'thanks a lot', 'the'])}" for _ in range(150)]
    texts += [f'token = "{digits(20)}{digits(19)}a" {prose(3, i)}' for i in range(8)] + ['token = "my2nd-phrase" here', "token = 7 men", None, ""]
    given = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for some in (texts, given):
        got = {x["doc_id"]: x for x in pii.personal_data(docs(spark, some)).collect()}
        want = plain_learnt(some)
        assert [got[i]["spans"] for i in range(len(some))] == want
        assert all(got[i]["n_spans"] == len([s for s in w.split(",") if s]) for i, w in enumerate(want))
    assert sum(x["n_learnt"] for x in got.values()) + sum(x["n_secret"] for x in got.values()) > 0


# --- 6 url rules


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    urls = ["http://A.example.NET/en/x?y#z", "https://example.com/de/1", "https://example.com/en/1", "net", None, "", "x://net", "x://net/", "a://b://c/d", "http://sub.org/fr/é", "http://xorg/fr/", "http://notexample.com/de/", "http://example.net/en", "http://h?q/p", "http://h#f/p", "http://a.net\n/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://b.net/", "h")], "page_id long, url string, html string")
    got = url_rules.url_verdicts(pages, labels(spark)).collect()
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert len(got) == len(urls) + 1
    for x in got:
        host, path = plain_url(urls[x["page_id"]] if x["page_id"] is not None else "http://b.net/")
        fits = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == (host, path, rule, rules.get(rule, "allow"))
    assert url_rules.url_verdicts(pages.limit(0), labels(spark)).count() == 0


def test_mined_rules(spark):
    r = random.Random(8)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://{r.choice(['www', 'm'])}.{'casino' if bad or r.random() < 0.05 else r.choice(['news', 'blog'])}{'' if i % 2 else ''}.test/{'win' if bad else r.choice(['win', 'a', 'b'])}/{i}?ref={i}"))
        if i < 300:
            marks += [(i, 0 if bad else 1, 0)] * (1 + i % 2)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {x["page_id"]: x for x in url_rules.url_verdicts(pages, labels(spark, [*marks, (None, 0, 0), (5000, None, None)]), min_support=0.02, min_confidence=0.8).collect()}
    assert all(got[i]["verdict"] == "block" for i in range(0, 400, 4)) and sum(got[i]["verdict"] == "block" for i in range(400) if i % 4) < 30
    # by brute force: all rules, and each page's best one that its tokens hold
    want = plain_rules(_labelled(pages, marks).collect(), 0.02, 0.8)
    mined = {tuple(m["tokens"]): (m["confidence"], m["pages"]) for m in url_rules.mine(_labelled(pages, marks), 0.02, 0.8).collect()}
    assert mined == want and mined
    sets = {x["page_id"]: set(x["tokens"]) for x in _tokens(pages).collect()}
    for i, tokens in sets.items():
        assert got[i]["mined_confidence"] == max((c for m, (c, _) in mined.items() if set(m) <= tokens), default=None)


def plain_rules(labelled, min_support, min_confidence, min_pages=20, min_z=4.0):
    """All token sets by enumeration: {tokens: (confidence, pages)} of those that the module's docstring keeps."""
    rows = [(set(x["tokens"]), x["bad"]) for x in labelled]
    n, p = len(rows), sum(b for _, b in rows) / max(1, len(rows))
    least = max(min_pages, int(np.ceil(min_support * n)))
    covers = {}
    for t in sorted(set().union(*[s for s, _ in rows])):
        cover = tuple(i for i, (s, _) in enumerate(rows) if t in s)
        if sum(rows[i][1] for i in cover) >= least:
            covers.setdefault(cover, t)
    tokens = sorted(covers.values())
    found = {}
    for mask in range(1, 1 << len(tokens)):
        some = tuple(t for i, t in enumerate(tokens) if mask >> i & 1)
        holds = [b for s, b in rows if s.issuperset(some)]
        if sum(holds) >= least:
            found[some] = (sum(holds) / len(holds), len(holds))
    needed = {s: v for s, v in found.items() if not any(set(x) < set(s) and found[x][0] >= v[0] for x in found)}
    z = lambda c, m: (c * m - m * p) / np.sqrt(m * p * (1 - p))
    return {s: (c, m) for s, (c, m) in needed.items() if c >= min_confidence and c > p and z(c, m) >= min_z}


def test_mined_rules_of_many_tokens(spark):
    """Rules that need several tokens, a long URL that occurs often, and labels that don't depend on URLs."""
    r = random.Random(18)
    rows, marks = [], []
    for i in range(900):
        path = [x for x in "abcdefg" if r.random() < 0.6]
        rows.append((i, f"http://h.test/{'/'.join(x * 3 for x in path) or 'none'}"))
        marks.append((i, 0 if {"a", "b", "c"} <= set(path) and r.random() < 0.9 or r.random() < 0.05 else 1, 0))
    long = "http://h.test/" + "/".join(f"word{chr(97 + j)}x" for j in range(22)) + "/" + "/".join(f"w{chr(97 + j)}{chr(98 + k)}q" for j in range(20) for k in range(20))
    rows += [(1000 + i, long) for i in range(40)]
    marks += [(1000 + i, i % 2, 0) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    mined = {tuple(m["tokens"]): (m["confidence"], m["pages"]) for m in url_rules.mine(_labelled(pages, marks), 0.002, 0.5).collect()}
    assert mined == plain_rules(_labelled(pages, marks).collect(), 0.002, 0.5) and ("p:aaa", "p:bbb", "p:ccc") in mined
    chance = [(i, int(r.random() > 0.3), 0) for i, _ in rows]
    assert url_rules.mine(_labelled(pages, chance), 0.002, 0.3).count() == 0


def test_pages_odd(spark):
    """Null, empty, very long and repeated URLs, null and repeated ids, and columns whose names the operator uses."""
    urls = [None, "", "://", "http://a.net/" + "x/" * 200_000, "http://a.org/" + "y" * 300_000, "http://a.net/x", "http://a.net/x", "http://b.test/?" + "&".join(f"k{i}=1" for i in range(3000))]
    rows = [(i if i < 6 else None, u) for i, u in enumerate(urls)] + [(5, "http://c.org/fr/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for clash in ("tokens", "host", "path", "rule", "verdict", "row", "bad", "set_id", "salt", "best", "n", "k"):
        pages = pages.withColumn(clash, F.lit("z"))
    got = url_rules.url_verdicts(pages, labels(spark, [(i, 0, 1) for i in range(6)])).collect()
    assert collections.Counter((x["page_id"], x["verdict"]) for x in got) == collections.Counter([(0, "allow"), (1, "allow"), (2, "allow"), (3, "block"), (4, "allow"), (5, "block"), (None, "block"), (None, "allow"), (5, "allow")])
    assert url_rules.url_verdicts(pages.limit(0), labels(spark)).count() == 0


def _tokens(pages):
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    return pages.select("page_id", url_rules.tokens(F.col("url"), host, path).alias("tokens"))


def _labelled(pages, marks):
    good = pages.sparkSession.createDataFrame([(i, q == 0) for i, q, _ in dict.fromkeys(marks)], "page_id long, bad boolean")
    return _tokens(pages).join(good, "page_id").withColumnRenamed("page_id", "row")


# --- 10 near dedup


def near_texts(seed=3):
    r = random.Random(seed)
    out = []
    for g in range(12):
        base = prose(r.choice([6, 30, 120, 300]), g).split()
        for _ in range(r.randrange(1, 9)):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 12))):
                t[r.randrange(len(t))] = f"edit{r.randrange(10**6)}"
            out.append(" ".join(t))
    r.shuffle(out)
    return out + ["a b", "A  b", "", None, "one", out[0].upper(), out[1] + " tail"]


def plain_components(texts, percent=75):
    sets = []
    for t in texts:
        w = plain_words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    least = list(range(len(texts)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 4])
def test_near_groups(spark, monkeypatch, block):
    """With blocks of four sets, most buckets need the second step."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    texts = near_texts()
    sizes, roots = plain_components(texts)
    got = {x["doc_id"]: x for x in near_dedup.near_groups(docs(spark, texts)).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (sizes[i], roots[i], roots[i] == i)


def test_near_groups_at_the_limit(spark, monkeypatch):
    """A group of edited copies of one text, of similarities around the limit: many are linked with none, some by one other."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 32)
    r = random.Random(5)
    base, texts = prose(120, 77).split(), []
    for _ in range(220):
        t = list(base)
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(t))
    sizes, roots = plain_components(texts)
    assert 20 < len(set(roots)) < 200
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == roots


def test_near_odd(spark):
    got = near_dedup.near_groups(odd(spark)).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == 11 and by[8]["component_id"] == 7 and by[6]["component_id"] == 5 and by[0]["n_shingles"] == 0 and by[None]["component_id"] is None and by[None]["kept"]
    twice = {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(docs(spark, [prose(20, 1), prose(20, 2), prose(20, 2), prose(20, 1)], [4, 9, 4, 2])).collect()}
    assert twice == {4: 2, 9: 2, 2: 2}
    named = near_dedup.near_groups(docs(spark, [prose(20, 1), prose(20, 1)], [None, 3])).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in named) == [(0, 0, True), (3, 3, True)]
    assert near_dedup.near_groups(docs(spark, [])).count() == 0


def test_shared_counts():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    for m in (2, 5, 90):
        sets = [np.unique(r.choice(pool, r.integers(1, 300))) for _ in range(m)]
        both = near_dedup.shared_counts(sets)
        assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(m) for j in range(m) if i != j)


def test_reaches_is_the_estimate():
    r = np.random.default_rng(4)
    a, b = r.integers(80, 100, 2000).astype(float), r.integers(80, 100, 2000).astype(float)
    same = r.integers(40, 120, 2000)
    more = r.binomial(128 - same, 0.5)
    j = near_dedup.estimate(a, b, more, 128 - same - more, same)
    clear = abs(j - 0.56) > 1e-4
    assert ((j >= 0.56) == near_dedup.reaches(0.56, a, b, more, 128 - same - more, same))[clear].all()


def test_sketches():
    r = np.random.default_rng(9)
    a, b, c = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 300, 600))
    sketch = lambda s: near_dedup.registers(near_dedup.minima(s))
    assert (near_dedup.merged(sketch(a), sketch(b)) == sketch(np.concatenate([a, b]))).all()
    errors = []
    for k in range(40):
        s = r.integers(0, 1 << 63, 500, dtype=np.uint64)
        t = np.concatenate([s[:400], r.integers(0, 1 << 63, 50, dtype=np.uint64)])
        x, y = sketch(s), sketch(t)
        more, less = (x > y).sum(), (x < y).sum()
        j = near_dedup.estimate(np.array([500.0]), np.array([450.0]), np.array([more]), np.array([less]), np.array([near_dedup.REGISTERS - more - less]))[0]
        errors.append(j - 400 / 550)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert sketch(c).min() > 0 and sketch(c).max() < near_dedup.Q


def test_components(spark):
    r = random.Random(10)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 640)]
    least = {}
    for _ in range(300):
        for a, b in pairs:
            m = min(least.get(a, a), least.get(b, b))
            least[a] = least[b] = m
    got = {x["id"]: x["component"] for x in near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(i, i) == c for i, c in least.items())


# --- 4 decontamination


def plain_align(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment():
    r = np.random.default_rng(11)
    for _ in range(200):
        a, b = (r.integers(0, 5, r.integers(1, 30)).astype(np.uint64) for _ in range(2))
        score, s, e = decontaminate.aligned(a, b)
        assert score == plain_align(a.tolist(), b.tolist()) and (not score or plain_align(a.tolist(), b[s:e].tolist()) == score)


def test_leaks(spark):
    r = random.Random(12)
    items = [prose(r.randrange(20, 50), 100 + i) for i in range(12)] + ["two words", "", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    texts, want = [], set()
    for i in range(60):
        text = prose(r.randrange(50, 400), i).split()
        if i % 3 == 0:
            item = r.randrange(12)
            copy = items[item].upper().split()
            if i % 2:
                copy[r.randrange(len(copy))] = "edited"
                del copy[len(copy) // 2]
            at = r.randrange(len(text))
            text[at:at] = copy
            want.add((i, item))
        texts.append("  ".join(text))
    for block in (20_000, 5):
        got = decontaminate.leaks(docs(spark, texts), bench, block_items=block).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want
    for x in got:
        found = texts[x["doc_id"]][x["start"] : x["end"]].lower().split()
        assert found[0] in items[x["item_id"]] and abs(len(found) - len(items[x["item_id"]].split())) <= 3 and 0.5 <= x["score"] <= 1
    short = decontaminate.leaks(docs(spark, ["say two words here", "two other words"]), bench).collect()
    assert [(x["doc_id"], x["item_id"], x["score"]) for x in short] == [(0, 12, 1.0)]
    assert decontaminate.leaks(odd(spark), bench).count() == 0 and decontaminate.leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_leaks_by_all_alignments(spark):
    """Every document against every item: edited copies of short and long items, found as aligning all of them finds."""
    r = random.Random(41)
    items = [prose(r.choice([2, 4, 15, 18, 30, 45, 59]), 7000 + i).split() for i in range(60)]
    texts = []
    for k in range(240):
        item = list(items[k % 60])
        for i in r.sample(range(len(item)), r.randrange(0, len(item) // 3 + 1)):
            item[i : i + 1] = r.choice([[f"edit{r.randrange(10**6)}"], [], ["more", f"new{i}"]])
        texts.append(" ".join([prose(r.randrange(20, 60), 100 + k), *item, prose(r.randrange(20, 60), 900 + k)]))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.leaks(docs(spark, texts), bench).collect()}
    hashed = lambda words: np.concatenate([w.hash for w in textkit.words(pa.array([" ".join(words)]))])
    queries, missed, total = [hashed(x) for x in items], collections.Counter(), collections.Counter()
    for d, t in enumerate(texts):
        own = hashed(t.split())
        for i, q in enumerate(queries):
            score = decontaminate.aligned(q, own)[0] / (2 * len(q))
            if score >= 0.5:
                total[len(q)] += 1
                missed[len(q)] += (d, i) not in got
            else:
                assert (d, i) not in got
            if (d, i) in got:
                assert abs(got[d, i] - score) < 1e-9
    long = [n for n in total if n >= 8]
    assert sum(total[n] for n in long) > 150 and sum(missed[n] for n in long) <= 0.01 * sum(total[n] for n in long), (missed, total)


def test_common_items_keep_their_seeds(spark):
    item = prose(30, 77)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.leaks(docs(spark, [f"{prose(20, i)} {item} {prose(20, 900 + i)}" for i in range(50)]), bench).count() == 50


# --- 7 repeated passages


def test_compact_windows():
    r = np.random.default_rng(13)
    h = r.integers(0, 1 << 30, 120).astype(np.uint32)
    windows = list(substring_dedup.compact_windows(h, 10))
    for a in range(0, 120 - 10, 7):
        for b in (a + 9, min(119, a + 30)):
            c = a + int(h[a : b + 1].argmin())
            assert sum(left <= a and b <= right and c == m for left, m, right in windows) == 1


def test_windows_of_long_and_repetitive_texts():
    """The tree against its definition, also where hashes are equal; a text of one word takes time in proportion."""
    r = np.random.default_rng(14)
    for h in (r.integers(0, 5, 6000), np.zeros(5000, int), np.arange(4100), np.arange(4100)[::-1], np.tile([3, 1, 2, 1], 1200)):
        want, stack = set(), [(0, len(h) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a + 1 >= 46:
                c = a + int(h[a : b + 1].argmin())
                want.add((a, c, b))
                stack += [(a, c - 1), (c + 1, b)]
        assert set(substring_dedup.compact_windows(h.astype(np.uint32), 46)) == want
    began = time.perf_counter()
    for w in textkit.words(pa.array(["word " * 1_000_000])):
        assert len(substring_dedup._filed(w, np.array([7]), 46)) <= 2 * 1_000_000 / substring_dedup.REPEATED + 200
    assert time.perf_counter() - began < 90


def test_repeated_passages_in_repetitive_texts(spark):
    """Passages that run into a long repetition, on either side, and repetitions alone."""
    texts = []
    for k, filler in enumerate(("ha", "ha ho", "a b c d e f g")):
        tail, head = prose(40, 70 + k), prose(40, 80 + k)
        for reps in (40, 400, 3000):
            texts.append(f"{prose(60, 100 * k + reps)} {head} {filler + ' '} {(filler + ' ') * reps}{tail} {prose(60, 100 * k + reps + 1)}")
    got = {(x["doc_id"], x["first_doc_id"]) for x in substring_dedup.repeated_passages(docs(spark, texts)).collect()}
    assert {x for x, _ in got} == {1, 2, 4, 5, 7, 8}


def plain_passages(texts, least=50):
    """Pairs (later, earlier) of texts that hold an equal passage of least words, by all word n-grams."""
    held, out = collections.defaultdict(set), set()
    for i, t in enumerate(texts):
        w = plain_words(t)
        mine = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        for g in mine:
            out |= {(i, j) for j in held[g]}
        for g in mine:
            held[g].add(i)
    return out


def test_passages_by_all_pairs(spark):
    """A whole given table: every document that holds an equal passage of an earlier one is found, nearly each of its
    passages, and nothing is reported that isn't similar."""
    rows = [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    r = random.Random(31)
    for k in range(150):  # passages of 50 to 90 words dealt over documents
        i, j = sorted(r.sample(range(len(rows)), 2))
        p = prose(r.randrange(50, 91), 9000 + k)
        for d in (i, j):
            w = rows[d].split(" ")
            cut_at = r.randrange(len(w) + 1)
            rows[d] = " ".join([*w[:cut_at], p, *w[cut_at:]])
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    pairs = plain_passages(rows)
    later = {i for i, _ in pairs}
    assert len(later) > 100 and later <= {x["doc_id"] for x in got}
    spans = collections.defaultdict(list)
    for x in got:
        spans[x["doc_id"]].append((x["start_word"], x["end_word"]))
    held, total, missed = {}, 0, 0
    for i, t in enumerate(rows):
        w = plain_words(t)
        grams = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, g in enumerate(grams):
            if held.get(g, i) < i:
                total += 1
                missed += not any(a <= k and b >= k + 50 for a, b in spans[i])
        for g in grams:
            held.setdefault(g, i)
    assert total > 2000 and missed <= 0.01 * total, (missed, total)


def test_repeated_passages(spark):
    passage, other = prose(60, 50).split(), prose(90, 51).split()
    edited = [*other[:45], "changed", *other[46:]]
    short = prose(45, 52).split()
    texts, at = [], {}
    for i in range(40):
        text = prose(120, 500 + i).split()
        for k, (every, p) in enumerate(((4, passage), (5, other if i < 20 else edited), (3, short))):
            if i % every == 0:
                at[i, k] = len(text)
                text += [*p, *prose(70, 900 + 10 * i + k).split()]
        texts.append(" ".join(text))
    texts += ["", None, "a b c", prose(60, 50)]
    got = substring_dedup.repeated_passages(docs(spark, texts, parts=4)).collect()
    found = collections.defaultdict(list)
    for x in got:
        assert x["first_doc_id"] < x["doc_id"] and x["similarity"] >= 0.75 and x["end_word"] - x["start_word"] >= 50
        mine, first = texts[x["doc_id"]].split(), texts[x["first_doc_id"]].split()
        a, b = mine[x["start_word"] : x["end_word"]], first[x["first_start_word"] : x["first_end_word"]]
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert abs(len(s & t) / len(s | t) - x["similarity"]) < 1e-9
        found[x["doc_id"]].append((x["start_word"], x["end_word"]))
    for (i, k), start in at.items():
        if k < 2 and i > 0:
            assert any(a <= start and b >= start + (60, 90)[k] for a, b in found[i]), (i, k, found[i])
    assert set(found) <= {i for i, k in at if k < 2} | {len(texts) - 1} and found[len(texts) - 1] == [(0, 60)]


def test_passages_in_a_looser_alignment():
    """Templates with many edits: each equal stretch of 50 words lies in a passage, and all passages reach 75 %."""
    r, stretches = np.random.default_rng(3), 0
    for trial in range(300):
        n, share = ((250, 0.04), (300, 0.05), (500, 0.04))[trial % 3]
        b = r.integers(1, 1 << 62, n).astype(np.uint64)
        if trial % 2:  # words that repeat
            b[10 * np.arange(n // 10)] = b[0]
        edits = r.random(n) < share
        a = np.where(edits, r.integers(1, 1 << 62, n).astype(np.uint64), b)
        got = substring_dedup.passages(a, b, 50, 75)
        assert all(y - x >= 50 and j >= 0.75 for x, y, _, _, j in got)
        bounds = np.concatenate([[-1], np.flatnonzero(edits), [n]])
        for x, y in zip(bounds[:-1] + 1, bounds[1:]):
            if y - x >= 50:
                stretches += 1
                assert any(s <= x and e >= y for s, e, *_ in got), (trial, x, y, got)
    assert stretches > 100
    # an equal passage that holds a phrase the other text repeats very often
    common, passage = np.arange(1, 8, dtype=np.uint64), r.integers(1, 1 << 62, 50).astype(np.uint64)
    passage[20:27] = common
    fresh = lambda k: r.integers(1, 1 << 62, k).astype(np.uint64)
    other = np.concatenate([*[x for _ in range(12) for x in (common, fresh(15))], passage, fresh(30)])
    assert [(s, e) for s, e, *_ in substring_dedup.passages(np.concatenate([fresh(90), passage]), other, 50, 75)] == [(90, 140)]


def test_passages_in_blocks(spark, monkeypatch):
    """Every block of one row: what a task joins by itself and what is dealt out give the same."""
    texts = [f"{prose(30, i)} {prose(80, 7)} {prose(30, 100 + i)}" for i in range(30)]
    whole = sorted(map(tuple, substring_dedup.repeated_passages(docs(spark, texts, parts=1)).collect()))
    parts = sorted(map(tuple, substring_dedup.repeated_passages(docs(spark, texts, parts=11)).collect()))
    # the words beside a passage may agree with those of another document by chance: a wider passage, beside the wanted one
    own = lambda rows: [r for r in rows if r[2:4] == (30, 110)]
    assert all(r[2] <= 35 and r[3] >= 105 for r in whole + parts), whole
    # dealt over tasks, a document may be joined to the first of its task, but the first of all is named
    assert own(parts) == own(whole) and [r[:2] for r in own(whole)] == [(i, 0) for i in range(1, 30)]


def test_passages_past_a_fragment(spark):
    """The smallest id holds a part of a passage; others that share all of it still meet, as do documents that hold the part first."""
    texts, wanted = [], []
    for k in range(60):
        n, part = ((50, 40), (60, 49), (60, 40))[k % 3]
        passage = prose(n, 3000 + k).split()
        at = (n - part) * (k // 3 % 2)
        fragment = " ".join(passage[at : at + part])
        hub = f"{prose(70, 4000 + k)} {fragment} {prose(70, 5000 + k)}"
        if k % 4 == 3:  # the smallest id holds all of it too, but later
            hub += f" {' '.join(passage)} {prose(70, 6000 + k)}"
        texts += [hub, *(f"{prose(70, 7000 + 10 * k + j)} {' '.join(passage)} {prose(70, 8000 + 10 * k + j)}" for j in range(2))]
        wanted.append([3 * k + 2, 3 * k + 1] if k % 4 != 3 else [3 * k + 1, 3 * k])
        wanted += [[3 * k + 2, 3 * k + 1]] * (k % 4 != 3) + [[3 * k + 2, 3 * k]] * (k % 4 == 3)
    found = {(x["doc_id"], x["first_doc_id"]) for x in substring_dedup.repeated_passages(docs(spark, texts)).collect()}
    missed = [w for w in wanted if tuple(w) not in found]
    assert len(missed) <= 0.03 * len(wanted), missed


def test_windows_meet():
    """Rows of a key that allow a passage in common are linked, directly or by heads."""
    r = np.random.default_rng(8)
    for _ in range(300):
        n, least = int(r.integers(2, 30)), 46
        left = r.integers(0, 60, n)
        rows = np.column_stack([np.zeros(n), np.arange(n), np.zeros(n), left, np.maximum(0, least - 1 - left) + r.integers(0, 15, n), r.integers(1, 8, n), np.zeros(n)]).astype(np.int64)
        link, head, kept = substring_dedup._grouped(rows, least)
        assert kept[head].all()
        for j in range(3):
            for place in range(least):
                has = (rows[:, 3] >= place) & (rows[:, 4] >= least - 1 - place) & (rows[:, 5] >> j & 1 > 0)
                first = int(has.argmax())
                assert all(((link == x) & (head == first)).any() for x in np.flatnonzero(has) if x != first)


def test_passages_odd(spark):
    got = substring_dedup.repeated_passages(odd(spark)).collect()
    assert {(x["doc_id"], x["first_doc_id"]) for x in got} == {(6, 5)} and substring_dedup.repeated_passages(docs(spark, [])).count() == 0


# --- 5 quality, 1 mixing


def marked(n=600):
    """Prose is good, shouting and repetition are not; some prose is toxic."""
    texts, marks = [], []
    for i in range(n):
        kind = i % 5
        text = prose(60 + i % 40, i) if kind != 1 else (" ".join([f"BUY{i % 7}!!"] * 60) if i % 2 else prose(60, i).upper().replace(" ", "### "))
        if kind == 2:
            words = text.split()
            words[i % len(words)] = ("dreadful", "wretched")[i % 2] + "."
            words[(i * 7) % len(words)] = "vile"
            text = " ".join(words)
        texts.append(text)
        marks.append((i, int(kind != 1), int(kind == 2)))
    return texts, marks


def test_identity():
    """The linear-time form equals the sum over pairs."""
    from maskwright.llm.features import features

    x = next(features(pa.array(["some words in a row", "x"])))
    model = quality.FactorisationMachine(3, 5)
    model.weight[:] = np.random.default_rng(1).normal(size=len(model.weight))
    raw = model.raw(x)[0]
    for d in range(2):
        i, v = x.index[x.bound[d] : x.bound[d + 1]], x.value[x.bound[d] : x.bound[d + 1]].astype(float)
        pairs = sum(float(model.factor[i[a]] @ model.factor[i[b]]) * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(raw[d] - (float(model.weight[i] @ v) + pairs)) < 1e-3


def test_quality(spark):
    texts, marks = marked()
    got = {x["doc_id"]: x for x in quality.quality_scores(docs(spark, texts), labels(spark, [*marks, (None, 1, 0), (10**6, 0, 0), (7, None, None)])).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got.values())
    assert np.mean([got[i]["predicted"] == marks[i][1] for i in held]) > 0.97
    kept = {x["doc_id"] for x in quality.accepted(docs(spark, texts), labels(spark, marks)).collect()}
    assert np.mean([(i in kept) == bool(marks[i][1]) for i in held]) > 0.97


def test_quality_odd(spark):
    assert [x["score"] for x in quality.quality_scores(odd(spark), labels(spark)).collect()] == [0.5] * 11
    assert quality.quality_scores(docs(spark, []), labels(spark)).count() == 0
    kept = quality.accepted(odd(spark), labels(spark, [(7, 1, 0)]))
    assert kept.columns == odd(spark).columns and kept.count() == 11


def test_rates_match_targets(spark):
    texts, marks = marked()
    rows = [x.asDict() for x in mixing.mixing_rates(docs(spark, texts), labels(spark, marks)).collect()]
    p = np.array([[x["p_clean"], x["p_toxic"], x["p_junk"]] for x in rows])
    n, r = np.array([x["n_words"] for x in rows], float), np.array([x["rate"] for x in rows])
    assert np.allclose(p.sum(axis=1), 1) and (r >= 0).all()
    got = p.T @ (n * r)
    assert np.abs(got / got.sum() - np.array([0.95, 0.02, 0.03])).max() < 0.01
    # optimality: where a rate is above 0 the gradient is 0, and nowhere is it below
    goal = np.array([0.95, 0.02, 0.03]) / 0.95 * (p[:, 0] @ n)
    gradient = p @ ((got - goal) / goal.sum()) + mixing.PULL * (r - 1)
    assert np.abs(gradient[r > 0]).max() < 1e-5 and (gradient[r == 0] > -1e-5).all()
    kind = np.array([marks[x["doc_id"]][2] + 2 * (1 - marks[x["doc_id"]][1]) for x in rows])
    copies = np.array([x["copies"] for x in rows])
    assert (copies[kind == 0] >= 1).mean() > 0.98 and (copies[kind == 1] == 0).mean() > 0.8


def test_copies_match_targets(spark):
    """The rows delivered follow the fitted rates, also where these are small or near to a whole number."""
    sizes, share = np.array([3027, 449, 504]), np.array([0.95, 0.02, 0.03])
    rate = share / 0.95 * sizes[0] / sizes
    rows = spark.range(int(sizes.sum())).select("id", F.when(F.col("id") < 3027, 0).when(F.col("id") < 3476, 1).otherwise(2).alias("kind"))
    rows = rows.withColumn("copies", mixing._copies(F.element_at(F.array(*[F.lit(float(x)) for x in rate]), F.col("kind") + 1), F.col("id")))
    got = np.array([x["n"] for x in rows.groupBy("kind").agg(F.sum("copies").alias("n")).orderBy("kind").collect()])
    assert np.abs(got / got.sum() - share).max() < 0.01
    for wanted in (0.0, 0.2, 0.75, 1.0, 1.25, 1.9):
        mean = spark.range(20_000).select(F.avg(mixing._copies(F.lit(wanted), F.col("id")))).first()[0]
        assert abs(mean - wanted) < 0.02 and (wanted != int(wanted) or mean == wanted)


def test_delivered_totals(spark):
    """On the given table: expected tokens of each domain among the copies against the targets, and posteriors recomputed."""
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    rows = mixing.mixing_rates(*tables).toPandas()
    p = rows[["p_clean", "p_toxic", "p_junk"]].to_numpy()
    got = (p * (rows.n_words * rows.copies).to_numpy()[:, None]).sum(axis=0)
    assert np.abs(got / got.sum() - np.array([0.95, 0.02, 0.03])).max() < 0.01
    texts = {x["doc_id"]: x["text"] for x in tables[0].collect()}
    assert all(n == len(plain_words(texts[d])) for d, n in zip(rows.doc_id, rows.n_words))
    model = mixing.fit_domains(*tables)
    some = rows.head(200)
    again = np.concatenate([model.posteriors(x) for x in mixing.features(pa.array([texts[d] or "" for d in some.doc_id], pa.large_string()), mixing.STEMS)])
    assert np.allclose(again, some[["p_clean", "p_toxic", "p_junk"]].to_numpy(), atol=1e-6)
    kept = collections.Counter(x["doc_id"] for x in mixing.mixed(*tables).select("doc_id").collect())
    assert kept == {int(d): int(c) for d, c in zip(rows.doc_id, rows.copies) if c}


def test_unfitted_rates_raise(spark):
    known = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.9, 0.1])], "n_words long, posterior array<double>")
    with pytest.raises(ArithmeticError):
        mixing.fit_rates(known, [0.5, 0.5], max_steps=1)


def test_mixed_rows(spark):
    texts, marks = marked(200)
    copies = {x["doc_id"]: x["copies"] for x in mixing.mixing_rates(docs(spark, texts), labels(spark, marks)).collect()}
    got = mixing.mixed(docs(spark, texts), labels(spark, marks))
    assert got.columns == docs(spark, texts).columns
    assert collections.Counter(x["doc_id"] for x in got.collect()) == {i: c for i, c in copies.items() if c}
    table = odd(spark).withColumn("mixing_rate", F.lit(1)).withColumn("mixing_copies", F.lit(1))
    assert mixing.mixing_rates(table, labels(spark)).count() == 11
    # without labels every rate is the same, so that rows are kept by their keys only
    whole = mixing.mixed(table, labels(spark))
    assert whole.columns == table.columns and whole.count() > 0 and mixing.mixed(docs(spark, []), labels(spark)).count() == 0

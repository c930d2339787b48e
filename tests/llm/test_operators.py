"""Brute-force comparison and edge cases of the training-data operators on a small table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, item_id long, rule string"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    syl = "an er th la que ch on re ti st é ü de".split()
    return " ".join("".join(rng.choice(syl, int(rng.integers(1, 4)))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    a, b, c = prose(1, 120), prose(2, 200), prose(3, 90)
    w = b.split(" ")
    near = " ".join([*w[:50], "changed", *w[51:]])
    texts = [
        None, "", "   \n\t ", "one", "one", "One two", a, a, b, near, c + "\n" + a[:260] + "\n" + c[::-1],
        "x" * 700, "ab" * 300, prose(4, 3000), "mail .34@mail7.example.com or 4111 1111 1111 1111, 10.0.0.255 10.0.0.256 +1 (017) 555-7713 " + prose(5, 60),
        "call (017) 555-7713 " + prose(6, 60), "### $$$ %%% " * 40, "a | b | c | d | e\n" * 20, "é\n\n  double  spaces \t tab\n" + prose(7, 70), prose(8, 80) + "\n" + prose(8, 80),
    ]
    out = [(i, t, "en", "src0", len(t or ""), i, i, "r") for i, t in enumerate(texts)]
    out.append((6, a, "en", "src0", len(a), 0, 0, "r"))  # a repeated row
    out.append((None, c, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_pii(docs, rows, empty):
    from corvid.llm import pii

    got = sorted((tuple(r[:6]) for r in pii.find_pii(docs).collect()), key=key)
    want = []
    for d, t, *_ in rows:
        t, spans = t or "", []
        for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                    spans.append((kind, m.start(), m.end()))
        n = collections.Counter(k for k, _, _ in spans)
        want.append((d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert got == sorted(want, key=key)
    added = pii.find_pii(docs).filter("doc_id = 15").first()["spans"]
    assert added == "phone:5:19"
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs).collect()}
    assert "<EMAIL>" in masked[14] and "<CARD>" in masked[14] and masked[0] is None and masked[6] == rows[6][1]
    assert pii.find_pii(empty).count() == 0
    x, y = pii.labelled_windows(200, 77)
    tags, _ = pii.decode(pii.tagger(), x)
    assert (tags == y).mean() > 0.9


def test_url_filters(spark):
    from corvid.llm import url_filters as u

    urls = [None, "", "no scheme", "http://A.Example.ORG/en/12?q", "https://example.org", "https://x.com/de/", "ftp://com/fr/x#y", "http://notexample.org/es/", "http://example.org/es/a"]
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate([*urls, urls[3]])], "page_id long, url string, host string").select("page_id", "url")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge_urls(pages, u.rule_table(spark, u.RULES)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == got[9] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("example.org", "", None, "allow") and got[5][2:] == ("com/de/", "block") and got[6] == ("com", "/fr/x", "com/fr/", "allow")
    assert got[7][2:] == ("org/", "allow") and got[8][2:] == ("example.org/es/", "block")


def test_quality(docs, rows, empty):
    from corvid.llm.quality_rules import quality

    got = sorted((tuple(r[:7]) for r in quality(docs).collect()), key=key)
    want = []
    for d, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(grams)
        repeat = len({k + j for k, x in enumerate(grams) if n[x] > 1 for j in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)))
    assert got == sorted(want, key=key)
    kept = {r["doc_id"]: r["kept"] for r in quality(docs, with_text=True).collect()}
    assert kept[6] and kept[13] and not kept[16] and not kept[17] and not kept[0]
    assert quality(empty).count() == 0


def test_chat(spark):
    from corvid.llm.chat_formatting import format_chats

    call = '{"tool_calls":[{"id":"b","name":"fetch","arguments":{"url":{"$ref":"a"}}},{"id":"a","name":"search","arguments":"{\\"query\\":\\"q\\",\\"limit\\":1}"}]}'
    bad = '{"tool_calls":[{"id":"c","name":"search","arguments":{"limit":"x"}},{"id":"d","name":"f","arguments":{"x":{"$ref":"e"}}},{"id":"e","name":"f","arguments":{"x":{"$ref":"d"}}}]}'
    rows = [(1, 0, "user", "é"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"a","content":1}'), (1, 3, "tool", '{"tool_call_id":"b","content":2}'), (2, 0, None, None), (2, 1, "assistant", bad), (2, 2, "tool", '{"tool_call_id":"zz","content":0}'), (None, 0, "user", "{broken")]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "order_turn", "order_level", "turn", "item").collect()
    first = [(r["status"], r["call_id"]) for r in out if r["conv_id"] == 1]
    assert first == [("message", None), ("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    second = {r["call_id"]: (r["status"], r["valid"]) for r in out if r["conv_id"] == 2}
    assert second["c"] == ("unanswered_call", False) and second["d"][0] == second["e"][0] == "cyclic_call" and second["zz"][0] == "orphan_result"
    assert [r["json"] for r in out if r["conv_id"] is None] == ['{"content":"{broken","role":"user"}']


def test_decontamination(spark, docs, rows, empty):
    from corvid.llm import decontamination as d

    items = [(1, prose(50, 30) + " " + prose(51, 6)), (2, prose(52, 200) + "\n" + prose(53, 20)), (3, prose(54, 15)), (4, ""), (5, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(100, prose(60, 300) + " " + items[0][1] + " " + prose(61, 40)), (101, prose(62, 100) + "\n" + items[1][1].upper()), (102, items[2][1]), (103, prose(63, 400))]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in d.leaked_pairs(more, bench).collect()) == [(100, 1), (101, 2), (102, 3)]
    assert d.drop_leaking(more, bench).count() == more.count() - 3
    assert d.leaked_pairs(empty, bench).count() == 0 and d.leaked_pairs(docs, bench.limit(0)).count() == 0
    # Retrieval returns what scoring every item against every passage returns.
    index = d.build_index([(i, *d.split_item(t)) for i, t in items if t])
    words = d._hashes(texts[0][1])
    found = {(a, i): s for _, i, s, a, _ in d.search(index, words, np.zeros(len(words), np.int64))}
    for at in range(-index.stride, len(words), index.stride):
        have = set(words[max(at, 0) : at + 2 * index.stride].tolist())
        for i in range(index.n):
            score = sum(float(index.post_impact[p]) for k, t in enumerate(index.terms.tolist()) if t in have for p in range(index.post_at[k], index.post_at[k + 1]) if index.post_item[p] == i)
            if at >= 0:
                assert ((at, i) in found) == (score >= d.THRESHOLD - 1e-9)


def test_html(spark):
    from corvid.llm.html_extraction import extract, main_text

    page = '<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>menu</ul></nav><article class="post"><h1>Head &amp; shoulders</h1><p><b>One\n two<br>three<p>Four&copy;<div class="ad">buy</div><form><p>form</p></form><aside>x</aside></article><div id="comments"><p>c</p></div><footer>f</footer>'
    assert main_text(page) == "Head & shoulders\n\nOne two three\n\nFour©"
    plain = "<body><div class='x'><p>text %d</p></div><div class='legal'><p>same words</p></div></body>"
    rows = [(1, None, None, "z"), (2, "http://h/1", "", "z"), (3, "http://h/1", page, "z"), *[(10 + i, "http://site.org/a", plain % i, "z") for i in range(6)]]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[1] == got[2] == ("", 0) and got[3][0] == main_text(page)
    assert got[12][0] == "text 2"  # the branch that all pages of the host share is gone


def test_suffix_dedup(docs, rows, empty):
    from corvid.llm.suffix_dedup import remove_repeats

    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(r[k : k + 200] for r in raw for k in range(len(r) - 199))
    want = []
    for (d, *_), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r) for r in remove_repeats(docs).collect()), key=key) == sorted(want, key=key)
    assert remove_repeats(empty).count() == 0


def test_language(docs, empty):
    from corvid.llm.language_id import LanguageFusion, keep_known

    got = LanguageFusion(docs).score(docs, ["doc_id"]).collect()
    assert len(got) == docs.count() and {r["doc_id"]: r["kept"] for r in got}[6] and not {r["doc_id"]: r["kept"] for r in got}[0]
    assert keep_known(docs).columns == docs.columns
    assert LanguageFusion(empty).score(empty, ["doc_id"]).count() == 0


def test_jaccard(docs, rows, empty):
    from corvid.llm.jaccard_join import jaccard_components, one_of_each

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    want = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        want.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    assert sorted((tuple(r) for r in jaccard_components(docs).collect()), key=key) == sorted(want, key=key)
    kept = sorted(r["doc_id"] for r in one_of_each(docs).filter("doc_id IS NOT NULL").collect())
    assert kept == sorted({c for d, _, c in want if d is not None})
    assert jaccard_components(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    from corvid.llm.best_fit_packing import best_fit_decreasing, dual_feasible_bound, pack_documents, tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        start, end, k = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            want.append((d, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, end, k = end, end + 2048, k + 1
    got = pack_documents(docs, group_rows=7).collect()
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(empty).count() == 0
    assert dual_feasible_bound(np.array([6, 6, 6, 4, 4, 4]), 10) == 3 == best_fit_decreasing(np.array([6, 6, 6, 4, 4, 4]), 10)[2]
    assert dual_feasible_bound(np.array([6, 6, 6]), 10) == 3


def test_pipeline_columns(spark, docs):
    import corpus_pipeline as p

    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES[:2]:
        table = stage(spark, table, "/root/testdata/sf0.001")
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert table.count() > 5

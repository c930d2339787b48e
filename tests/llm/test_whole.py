"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import prose


def _leaks(items, text):
    from corvid.llm import decontamination as d

    index = d.build_index([(i, *d.split_item(t)) for i, t in items])
    words = d._hashes(text)
    row = np.zeros(len(words), np.int64)
    return {index.ids[i] for _, i in d.verify(index, words, d.search(index, words, row))}


def test_leaks_of_items_with_frequent_terms_only():
    # Each item three times: all of its terms are frequent.
    texts = [prose(300 + k, 25) + " " + prose(400 + k, 6) for k in range(5)]
    items = [(10 * k + c, t) for k, t in enumerate(texts) for c in range(3)]
    for k, t in enumerate(texts):
        assert _leaks(items, prose(500, 90) + " " + t + " " + prose(501, 30)) >= {10 * k, 10 * k + 1, 10 * k + 2}
    # Templated questions: every word stands in many items.
    names, places = "anna bert cleo dora emil fred".split(), "rome oslo kiev bern riga".split()
    items = [(k, f"How many kilometres did {a} travel to {b} by train last summer? The right answer is {a} to {b}.") for k, (a, b) in enumerate((a, b) for a in names for b in places)]
    for k, t in items[:5]:
        assert k in _leaks(items, prose(502, 90) + " " + t + " " + prose(503, 30))
    assert not _leaks(items, prose(504, 300))


def test_index_serves_no_lower_threshold():
    from corvid.llm import decontamination as d

    index = d.build_index([(1, prose(1, 20), prose(2, 5))])
    with pytest.raises(ValueError, match="threshold"):
        d.search(index, np.zeros(1, np.uint64), np.zeros(1, np.int64), 0.1)


def test_personal_data_of_any_length_at_any_offset():
    from corvid.llm import pii

    w = pii.tagger()
    before, after = prose(90, 60)[:200], prose(91, 20)
    for span in ("anna.schmidt (at) lists.example (dot) org", "firstname.lastname (at) department.university (dot) edu", "maria.fernanda.gonzalez (at) informatik.department.university (dot) example (dot) edu"):
        for offset in range(32):
            start = before[: 100 + offset]
            text = f"{start} {span} {after}"
            assert ("email", len(start) + 1, len(start) + 1 + len(span)) in pii.all_spans([text], w)[0][1], (span, offset)
            assert pii.mask(text, pii.all_spans([text], w)[0][1]) == f"{start} <EMAIL> {after}"
    assert pii.all_spans([prose(92, 3000), ""], w) == [([], []), ([], [])]


def test_every_declared_language_has_a_table(spark):
    from corvid.llm.language_id import LanguageFusion

    rare = ["fi", "eu", "cy", "mt", "ga"]
    rows = [(k, f"the words of row {k} are these and no others", "en") for k in range(6000)] + [(6000 + k, f"{x}zq " * 40, x) for k, x in enumerate(rare)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fusion = LanguageFusion(docs, host=None)
    assert fusion.langs == sorted([*rare, "en"])
    got = {r["doc_id"]: r["language"] for r in fusion.score(docs, ["doc_id"]).filter("doc_id >= 6000").collect()}
    assert got == {6000 + k: x for k, x in enumerate(rare)}


def test_long_chains(spark):
    from corvid.llm.chat_formatting import format_chats

    n = 70
    call = lambda k, after: f'{{"id":"c{k}","name":"f","arguments":{{"x":{{"$ref":"c{after}"}}}}}}' if after is not None else f'{{"id":"c{k}","name":"f","arguments":{{}}}}'
    text = '{"tool_calls":[' + ",".join([call(k, k - 1 if k else None) for k in range(n)] + [call(900, 901), call(901, 900)]) + "]}"
    out = {r["call_id"]: (r["status"], r["order_level"]) for r in format_chats(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")).collect()}
    assert out == {f"c{k}": ("unanswered_call", 2 * k) for k in range(n)} | {"c900": ("cyclic_call", 0), "c901": ("cyclic_call", 0)}


def test_one_row_of_each_component_with_repeated_ids(spark):
    from corvid.llm.jaccard_join import one_of_each

    a, b, c, d = (prose(700 + k, 60) for k in range(4))
    rows = [(1, a), (2, b), (2, c), (3, d), (3, a), (None, d), (None, "gone " + b), (4, ""), (4, ""), (None, None)]
    rows += [(None, prose(710, 50))] * 3
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, a), (2, b), (2, c), (3, d), (4, ""), (None, None), (None, prose(710, 50))]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_regions_are_divided_until_none_is_left(spark, monkeypatch):
    from corvid.llm import jaccard_join as j

    rng = np.random.default_rng(5)
    vocabulary = prose(800, 400).split(" ")
    rows = []
    for group in range(3):
        base = [vocabulary[k] for k in rng.integers(0, 400, 90)]
        for k in range(130):
            w = list(base)
            for at in rng.integers(0, 90, int(rng.integers(0, 5))):  # distances on both sides of the threshold
                w[at] = f"x{rng.integers(0, 50)}"
            rows.append((1000 * group + k, " ".join(w[: int(rng.integers(80, 91))])))
    rows.append((5000, " ".join(base[:3])))
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or frozenset([tuple(w)]) for w in (t.split(" ") for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if label[i] != label[k] and 100 * len(sets[i] & sets[k]) >= 85 * len(sets[i] | sets[k]):
                a, b = sorted((label[i], label[k]))
                label = [a if x == b else x for x in label]
    want = sorted((d, len(sets[i]), rows[label[i]][0]) for i, (d, _) in enumerate(rows))
    assert 3 < len(set(label)) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for small, meeting, ids in ((48, 4096, 200_000), (3, 100, 0), (3, 3, 200_000)):
        monkeypatch.setattr(j, "SMALL", small)
        monkeypatch.setattr(j, "MEETING", meeting)
        monkeypatch.setattr(j, "SENT_IDS", ids)
        assert sorted(tuple(r) for r in j.jaccard_components(docs).collect()) == want


def test_components_in_one_task_and_by_stars(spark, monkeypatch):
    from corvid.llm import graph

    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (100_000, 0):
        monkeypatch.setattr(graph, "ONE_TASK", most)
        assert {r["node"]: r["label"] for r in graph.components(df).collect()} == label
    assert graph.components(df.limit(0)).count() == 0


def test_words_that_polynomial_hashes_confuse():
    from tokenizers import Tokenizer

    import pyarrow as pa
    from corvid.llm.best_fit_packing import _encoder, tokenizer_path
    from corvid.llm.common import span_hashes
    from corvid.llm.quality_rules import judge

    thue = "".join("ab"[bin(k).count("1") & 1] for k in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((thue + other + "x" * 9000).encode(), np.uint8)
    h = span_hashes(data, np.array([0, 1024, 2048, 2049]), np.array([1024, 2048, 2048 + 8000, 2049 + 8000]))
    assert h[0] != h[1] and h[2] == h[3]
    text = f"{thue}\n{other}\n{thue}"
    data = np.frombuffer(text.encode(), np.uint8)
    assert judge(data, np.array([0, len(data)]))["n_dup_lines"].tolist() == [1]
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [f" {thue} {other}", "a <|endoftext|> b<|endoftext|>", "<|endoftext|>", "", "x  <|endoftext|><|endoftext|>\n\ny", "<|endoftext"]
    got = [np.frombuffer(x, "<u4").tolist() for x in _encoder(tokenizer_path()).encode(pa.array(texts))]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_text_is_judged_by_itself():
    from corvid.llm.quality_rules import judge

    a, b = prose(801, 60) + "\nplease read ", "more " + prose(802, 60)
    alone = [judge(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in (a, b)]
    both = np.frombuffer((a + b).encode(), np.uint8)
    got = judge(both, np.array([0, len(a.encode()), len(both)]))
    for name in ("kept", "lost_chars", "n_failed_lines", "n_lines", "n_dup_lines"):
        assert got[name].tolist() == [int(x[name][0]) for x in alone], name
    assert got["n_failed_lines"].tolist() == [0, 0]


def test_page_names_that_only_look_like_noise():
    from corvid.llm.html_extraction import main_text

    assert main_text('<body class="no-sidebar"><article><p>text</p></article></body>') == "text"
    assert main_text('<body><article class="post comment-open"><p>text</p><div class="ad-banner"><p>buy</p></div></article>') == "text"
    assert main_text('<div class="layout sidebar"><main><p>text</p></main></div>') == "text"
    assert main_text('<div class="sidebar"><article><p>teaser</p></article></div><article><p>text</p></article>') == "text"
    assert main_text('<main><p>text</p></main><div id="comments"><article><p>reply</p></article></div>') == "text"
    assert main_text('<article><p>text</p><article class="comment"><p>reply</p></article></article>') == "text"
    assert main_text('<article><p title="x>one</p><p title=">">two</p><p>three<p class="cut') == "one\n\ntwo\n\nthree"
    assert main_text('<article><script a="b">x</script><p>one</article>' + '<p title="' * 40_000) == "one"  # open quotes in linear time
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    words = " ".join(["w"] * 200_000)
    assert main_text(f"<article><p>{words}</p></article>") == words


def test_style_tree_against_brute_force(spark):
    import collections
    import math

    from corvid.llm.html_extraction import extract, read_page, style_tree

    page = "<body><div class='top'><p>same</p></div><div class='c'><p>one %d</p>%s</div><ul class='links'><li>%s</li></ul></body>"
    rows = [(k, "http://h.org/%d" % k, page % (k, "<p>more</p>" * (k % 3), "ab"[k % 2])) for k in range(9)] + [(20, "http://other/", page % (0, "", "")), (21, None, None)]
    seen = collections.defaultdict(collections.Counter)
    for _, url, source in rows:
        host = "h.org" if url and "h.org" in url else "other" if url else ""
        blocks, styles = read_page(source or "")
        text = collections.defaultdict(list)
        for b in blocks:
            text[b.path].append(b.text)
        for p, t in text.items():
            seen[host, p, "c"][tuple(t)] += 1
        for p, s in styles.items():
            seen[host, p, "s"][tuple(s)] += 1
    own = collections.defaultdict(float)
    for (host, p, _), n in seen.items():
        m = sum(n.values())
        own[host, p] = max(own[host, p], -sum(x / m * math.log(x / m) for x in n.values()) / math.log(m) if m > 1 else 1.0)
    want = {(h, p): max(v for (g, q), v in own.items() if g == h and (q == p or q.startswith(p + ">") or p == "")) for h, p in own}
    got = {(r["host"], r["path"]): r["importance"] for r in style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: round(v, 9) for k, v in got.items() if k in want} == {k: round(v, 9) for k, v in want.items()}
    texts = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts[4] == "one 4\n\nmore\n\na" and texts[20] == "same\n\none 0" and texts[21] == ""
    assert extract(spark.createDataFrame([], "page_id long, url string, html string, host string, low string")).count() == 0


def test_chats_that_are_hard_to_write(spark):
    from corvid.llm.chat_formatting import fits, format_chats

    schema = "conv_id long, turn long, role string, text string"
    rows = [
        (1, 0, "tool", '{"tool_call_id":"a\\ud800","content":"\\ud800 \\ud83d\\ude00"}'), (1, 1, "assistant", '{"tool_calls":[{"id":"a\\ud800","name":"f","arguments":{"x":1}}]}'),
        (2, 0, "tool", '{"tool_call_id":"a","content":NaN}'), (2, 1, "tool", '{"tool_call_id":"a","content":1e999}'), (2, 2, "user", "[" * 100_000), (2, 3, "user", '{"tool_calls":[{"id":"b","arguments":' + "[" * 900 + "]" * 900 + "}]}"), (2, 4, "user", "x" * 300_000),
    ]
    out = {(r["conv_id"], r["turn"]): (r["status"], r["json"]) for r in format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert out[1, 0] == ("result", '{"content":"\\ud800 \U0001f600","role":"tool","tool_call_id":"a\\ud800"}') and out[1, 1][0] == "call"
    assert out[2, 0] == ("message", '{"content":"{\\"tool_call_id\\":\\"a\\",\\"content\\":NaN}","role":"tool"}') and out[2, 1][0] == out[2, 2][0] == out[2, 4][0] == "message"
    assert len(out[2, 4][1]) > 300_000 and len(out) == len(rows)
    assert format_chats(spark.createDataFrame([], schema + ", call_id string, status string, refs string")).count() == 0
    s = {"type": "object", "properties": {"k": {"type": ["integer", "null"], "minimum": 1, "maximum": 3}, "e": {"enum": ["x", 1]}, "l": {"type": "array", "items": {"type": "string", "maxLength": 2}, "minItems": 1}}, "required": ["k"], "additionalProperties": {"type": "boolean"}}
    good = [{"k": 1}, {"k": None, "e": 1}, {"k": 3, "l": ["ab"], "z": True}, {"k": {"$ref": "a"}}]
    bad = [{}, {"k": 0}, {"k": 4}, {"k": True}, {"k": 1, "e": "y"}, {"k": 1, "l": []}, {"k": 1, "l": ["abc"]}, {"k": 1, "z": 1}, [], {"k": 1.5}]
    assert all(fits(x, s) for x in good) and not any(fits(x, s) for x in bad)


def test_links_against_brute_force(spark):
    from corvid.llm.chat_formatting import format_chats

    rng = np.random.default_rng(11)
    rows, calls, results = [], {}, {}
    for conv in range(12):
        for turn in range(14):
            if rng.random() < 0.5:
                made = []
                for _ in range(int(rng.integers(1, 4))):
                    name, refs = f"c{rng.integers(0, 12)}", [f"c{x}" for x in rng.integers(0, 12, int(rng.integers(0, 2)))]
                    calls.setdefault((conv, name), (turn, len(made), refs))
                    made.append('{"id":"%s","name":"f","arguments":{%s}}' % (name, ",".join(f'"x{k}":{{"$ref":"{r}"}}' for k, r in enumerate(refs))))
                rows.append((conv, turn, "assistant", '{"tool_calls":[' + ",".join(made) + "]}"))
            else:
                name = f"c{rng.integers(0, 12)}"
                results.setdefault((conv, name), turn)
                rows.append((conv, turn, "tool", '{"tool_call_id":"%s","content":0}' % name))
    placed = {}
    while True:  # (turn, level, done) of the calls whose references are all placed; references to no call don't wait
        more = {}
        for (conv, name), (turn, _, refs) in calls.items():
            waits = [(conv, r) for r in set(refs) if (conv, r) in calls]
            if (conv, name) not in placed and all(w in placed for w in waits):
                at = max([turn, *(placed[w][2] for w in waits)])
                more[conv, name] = (at, max([-1, *(placed[w][1] for w in waits)]) + 1, max(at, results.get((conv, name), turn)))
        if not more:
            break
        placed |= more
    for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        key = (r["conv_id"], r["call_id"])
        first = calls.get(key)
        if r["kind"] == "result":
            want = "result" if first else "orphan_result"
        elif first[:2] != (r["turn"], r["item"]):
            want = "duplicate_call"
        else:
            want = "cyclic_call" if key not in placed else "call" if key in results else "unanswered_call"
            if key in placed:
                assert (r["order_turn"], r["order_level"]) == (placed[key][0], 2 * placed[key][1])
        assert r["status"] == want
    assert 0 < len(placed) < len(calls)


def test_posterior_against_brute_force(spark):
    from corvid.llm import language_id as li

    rng = np.random.default_rng(2)
    words = {"en": "the and of to in that is".split(), "fr": "le la et les des que est".split(), "xx": "zq qz zz qq zqz qzq zzq".split()}
    rows = []
    for k in range(120):
        lang = ["en", "fr", "xx"][int(rng.integers(0, 3))]
        text = " ".join(rng.choice(words[lang], int(rng.integers(1, 30))))
        rows.append((k, text, lang if k % 7 else ("fr" if k % 2 else None), ["a.fr", "b.fr", "c.com", "d", None][int(rng.integers(0, 5))]))
    rows += [(200, "", "en", "d"), (201, None, None, None), (202, "12 34", "en", "d"), (203, rows[0][1], rows[0][2], rows[0][3]), (204, "le la the and " * 20_000, "xx", "a.fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    fusion = li.LanguageFusion(docs, "text", "lang", "host")
    got = {r["doc_id"]: r for r in fusion.score(docs, ["doc_id"]).collect()}
    langs = ["en", "fr", "xx"]
    assert fusion.langs == langs
    counts = np.full((3, li.BUCKETS), li.PRIOR)
    grams = lambda t: li._trigrams(np.frombuffer((t or "").encode(), np.uint8)) if len(t or "") > 2 else np.zeros(0, int)
    for _, t, d, _ in rows:
        if d and len(t or "") > 2:
            np.add.at(counts[langs.index(d)], grams(t), 1)
    tables = np.log(counts / counts.sum(1, keepdims=True))
    ll, letters, keys = [], [], []
    for _, t, d, h in rows:
        g = grams(t)
        ll.append(tables[:, g].mean(1) * min(len(g), li.EFFECTIVE) if len(g) else np.zeros(3))
        letters.append(any(c.isalpha() for c in t or ""))
        host = h or ""
        keys.append((d or "", host, host.rsplit(".", 1)[1] if "." in host else ""))
    soft = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in ll]
    total = lambda part, value: sum((s for s, ok, key in zip(soft, letters, keys) if ok and (part is None or key[part] == value)), np.zeros(3))
    for (doc, *_), x, ok, key in zip(rows, ll, letters, keys, strict=True):
        whole = total(None, None)
        p = (whole + 1) / (whole.sum() + 3)
        for part, weight in ((2, li.SUFFIX_WEIGHT), (1, li.HOST_WEIGHT)):
            c = total(part, key[part])
            p = (c + weight * p) / (c.sum() + weight)
        post = x + (np.log(p) + (np.log((total(0, key[0]) + 1) / (whole + 3)) if key[0] else 0) if ok else 0)
        if ok:
            q = np.exp(post - post.max()) / np.exp(post - post.max()).sum()
            assert got[doc]["language"] == langs[int(q.argmax())] and abs(got[doc]["posterior"] - q.max()) < 1e-4
            assert got[doc]["kept"] == (q.max() >= li.LEAST)
        else:
            assert not got[doc]["kept"]


def test_languages_of_pages(spark):
    from corvid.llm import language_id as li

    words = {"en": "the and of to in that is", "fr": "le la et les des que est"}
    pages = [(k, f"http://{h}.{lang}/p", f'<!DOCTYPE html><html class="a" lang="{lang.upper()}-XX"><body><article><p>{(words[lang] + " ") * 9}</p></article></body></html>') for k, (lang, h) in enumerate((a, b) for a in words for b in "ab" for _ in range(3))]
    pages += [(50, "http://a.fr/", f"<article><p>{words['fr']}</p></article>"), (51, None, None)]
    rows = li.page_texts(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["page_id"]: (r["lang"], r["host"], r["text"]) for r in rows.collect()}
    assert got[0][:2] == ("en", "a.en") and got[50] == (None, "a.fr", words["fr"]) and got[51] == (None, "", "")
    out = {r["page_id"]: r["language"] for r in li.LanguageFusion(rows, "text", "lang", "host").score(rows, ["page_id"]).collect()}
    assert out[0] == "en" and out[50] == "fr"


def test_disguised_personal_data_is_found():
    from corvid.llm import pii

    rng = np.random.default_rng(99)
    num = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    w, texts, want = pii.tagger(), [], []
    for k in range(240):
        kind = pii.KINDS[k % 4]
        if kind == "email":
            span = f"{prose(k, 1).strip('.')}.{num(2)}{[' (at) ', ' [at] ', '(at)'][k % 3]}mail{num(1)}{[' (dot) ', '[dot]', ' [dot] '][k % 3]}example{['.', ' (dot) '][k % 2]}org".encode("ascii", "ignore").decode()
        elif kind == "ip":
            span = ["[.]", " . "][k % 2].join(str(x) for x in rng.integers(0, 256, 4))
        elif kind == "card":
            d = num(15)
            d += next(str(c) for c in range(10) if pii.luhn(d + str(c)))
            span = [".", "/"][k % 2].join(d[i : i + 4] for i in range(0, 16, 4))
        else:
            span = [f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"][k % 3]
        before, after = prose(1000 + k, 30 + k % 9), prose(2000 + k, 20)
        texts.append(f"{before} {span} {after}")
        want.append((kind, len(before) + 1, len(before) + 1 + len(span)))
    found = pii.all_spans(texts, w)
    for kind in pii.KINDS:
        hits = [x in spans for x, (_, spans) in zip(want, found, strict=True) if x[0] == kind]
        print(kind, np.mean(hits))
        assert np.mean(hits) >= 0.9, kind
    clean = pii.all_spans([prose(3000 + k, 200) + f" in 20{num(2)}-0{k % 9 + 1}-1{k % 9}, {num(2)}:{num(2)}, {num(3)} of {num(5)}." for k in range(100)], w)
    assert sum(len(s) for _, s in clean) <= 2


def test_packing_is_certified(spark):
    from corvid.llm.best_fit_packing import bound_of_counts, certificate, dual_feasible_bound, pack

    rng = np.random.default_rng(8)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(1, 101, 600))]
    lengths = np.array([r[3] for r in rows])
    assert bound_of_counts(np.bincount(lengths, minlength=101), 100) == dual_feasible_bound(lengths, 100)
    pieces_df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").checkpoint()
    packed = pack(pieces_df, 100, group_rows=100)
    c = certificate(packed, 100).first()
    assert packed.count() == 600 and c["bound"] <= c["sequences"] <= 1.05 * c["bound"]


def test_long_items_are_indexed_apart(spark):
    from corvid.llm import decontamination as d

    long, short = prose(60, 2600), prose(61, 25) + " " + prose(62, 6)
    bench = spark.createDataFrame([(1, short), (2, long), (3, None)], "item_id long, text string")
    sizes = [(i.n, i.stride) for i in d.indexes(bench)]
    assert len(sizes) == 2 and sizes[0] == (1, 64) and sizes[1][0] == 1 and sizes[1][1] > 2000
    docs = spark.createDataFrame([(7, prose(63, 90) + " " + short), (8, long + " " + prose(64, 9)), (9, prose(65, 300)), (None, None), (10, "")], "doc_id long, text string").withColumns({"item_id": F.lit(1), "score": F.lit("x")})
    assert sorted((r["doc_id"], r["item_id"]) for r in d.leaked_pairs(docs, bench).collect()) == [(7, 1), (8, 2)]
    kept = d.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "9", "None"]


def test_leaks_do_not_depend_on_the_shards(spark, monkeypatch):
    from corvid.llm import decontamination as d

    names, places = "anna bert cleo dora emil fred".split(), "rome oslo kiev bern riga".split()
    items = [(k, f"How many kilometres did {a} travel to {b} by train last summer? The right answer is {a} to {b}.") for k, (a, b) in enumerate((a, b) for a in names for b in places)]
    items += [(100 + k, prose(900 + k, n)) for k, n in enumerate((20, 70, 90, 400, 12))] + [(200, ""), (201, None), (100, prose(900, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(950 + k, 80) + " " + items[k][1] + " " + prose(970 + k, 30) for k in (0, 1, 2, 17, 30, 31, 32, 33, 34)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for most in (1, 3, 20_000):
        monkeypatch.setattr(d, "SHARD_ITEMS", most)
        found.append(sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["question_overlap"], r["answer_overlap"]) for r in d.leaked_pairs(docs, bench).collect()))
    assert found[0] == found[1] == found[2]
    assert {(k, items[i][0]) for k, i in enumerate((0, 1, 2, 17, 30, 31, 32, 33, 34))} <= {r[:2] for r in found[0]}


def test_languages_are_read_as_subtags_and_names_of_columns_do_not_clash(spark):
    from corvid.llm.language_id import LanguageFusion, keep_known

    say = {"en": "the house and the garden are on the hill ", "de": "der garten und das haus liegen auf dem berg "}
    forms = {"en": ["en", "EN", " en ", "en-US", "en_GB"], "de": ["de", "De-at"]}
    rows = [(10 * k + j, say[x] * 3, f, "a.org", "b", True, 1, "r", 2) for k, x in enumerate(say) for j, f in enumerate(forms[x])]
    rows += [(100 + k, say["de"] * 3, junk, None, None, None, None, None, None) for k, junk in enumerate(["xx1", "german", "", None, "d", "--", "日本"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _host string, _letters boolean, _ll int, row string, kept int")
    fusion = LanguageFusion(docs)
    assert fusion.langs == ["de", "en"]
    got = {r["doc_id"]: r["language"] for r in fusion.score(docs, ["doc_id"]).collect()}
    assert got == {r[0]: "en" if r[1].startswith("the") else "de" for r in rows}
    kept = keep_known(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_long_runs_are_decoded_in_chunks(monkeypatch):
    from corvid.llm import pii

    w = pii.tagger()
    rng = np.random.default_rng(4)
    parts = []
    for k in range(700):
        parts.append(str(rng.integers(0, 10 ** int(rng.integers(1, 9)))))
        if k % 60 == 7:
            parts.append(("call (017) 555-7713 now", "mail anna.lee (at) mail.example (dot) org today", "card 4111.1111.1111.1111 paid")[k % 3])
    text = " ".join(parts)
    assert max(m for _, m in pii._runs(pii.window_starts(text))) > 2 * pii.CHUNK
    got = pii.all_spans([text], w)
    monkeypatch.setattr(pii, "CHUNK", 1 << 30)
    assert got == pii.all_spans([text], w) and len(got[0][1]) >= 8
    assert pii.window_starts("7" * 5000) == []
    assert pii._agreed(np.zeros(512), np.ones(512)) is None


def test_repeated_calls_are_duplicates(spark):
    from corvid.llm.chat_formatting import format_chats

    call = lambda i, x: f'{{"tool_calls":[{{"id":"{i}","name":"f","arguments":{{"x":{x}}}}}]}}'
    rows = [(1, 3, "assistant", call("a", 1))] * 3 + [(1, 3, "assistant", call("b", 2)), (1, 3, "assistant", call("b", 1)), (1, 4, "tool", '{"tool_call_id":"a","content":0}')] + [(2, 1, "user", "hi")] * 2 + [(None, None, "assistant", call("a", 1))] * 2
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = sorted((r["conv_id"] or 0, r["call_id"] or "", r["status"], r["json"][:20] if r["call_id"] == "b" else "") for r in out.collect())
    b = [(r["status"], '"x":1' in r["json"]) for r in out.filter("call_id = 'b'").orderBy("status").collect()]
    assert b == [("duplicate_call", False), ("unanswered_call", True)]
    assert [g[2] for g in got if g[0] == 1 and g[1] == "a"] == ["call", "duplicate_call", "duplicate_call", "result"]
    assert sum(g[2] == "message" for g in got) == 2

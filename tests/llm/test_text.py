import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithic.llm import chat_format, html_extract, packing, token_counts

SPEC = "doc_id long, text string, lang string, source string, n_chars long, length int"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), 1) for k, t in texts], SPEC)


# ---- chat formatting ---------------------------------------------------------

NASTY = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "<", "|", "<|nl|>", "a\nb", "", None, "<|im_end|>\n<|im_start|>assistant\nx", "é<|", "$1 \\1"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole", "<|im_end|>", None]), rng.choice(NASTY)) for c in range(30) for t in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", "of no conversation"), (5, None, "assistant", "first"), rows[0], (40, 0, "assistant", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    done = chat_format.format_turns(df)
    loss = chat_format.read_loss(F.col("formatted"), F.col("loss_mask"))
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", "n_turns", chat_format.read_turns(F.col("formatted")).alias("turns"), loss.alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "") for r in own]
        assert [(t.role, t.text) for t in got[c].turns] == want and got[c].n_turns == len(want)
        assert "".join(got[c].loss) == "".join(t for r, t in want if r == "assistant")
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}, "share_system", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "input": "it", "output": "done", "score": 0.5}, "instruction_input", [("user", "do\n\nit"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"question": "p", "answer": "c", "input": None}, "question_answer", [("user", "p"), ("assistant", "c")]),
        ({"something": "else"}, None, None),
    ]
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(records)] + [(6, None), (7, "{broken"), (8, json.dumps(records[3][0]))]
    df = spark.createDataFrame([(*r, "old") for r in rows], "id long, raw string, layout string")
    got = {r.id: r for r in chat_format.canonical_records(df, "raw").collect()}
    for k, (_, layout, turns) in enumerate(records):
        assert got[k].layout == layout and (got[k].turns and [(t.role, t.text) for t in got[k].turns]) == turns
    assert got[6].layout is None and got[7].turns is None and got[8].turns == got[3].turns
    plan = chat_format.canonical_records(df, "raw")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError, match="fingerprint"):
        chat_format.table_mapping(df)


def test_chat_records_that_fit_a_mapping(spark):
    """Records with fields of several layouts, or nulls in their own, keep their turns."""
    said = [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    records = [
        ({"prompt": "p", "messages": said}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "p", "response": "r", "question": "x"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "instruction": "do", "input": "it", "output": "done"}, "instruction_input_system", [("system", "s"), ("user", "do\n\nit"), ("assistant", "done")]),
        ({"instruction": "do", "output": None}, "instruction", [("user", "do"), ("assistant", "")]),
        ({"system": "s", "prompt": "p", "response": None}, "prompt_response_system", [("system", "s"), ("user", "p"), ("assistant", "")]),
        ({"question": "x", "answer": "y", "prompt": "p", "completion": None}, "question_answer", [("user", "x"), ("assistant", "y")]),
        ({"prompt": None, "completion": None}, None, None),
        ({"instruction": "do", "input": "", "output": "x"}, "instruction_input", [("user", "do"), ("assistant", "x")]),
        ({"instruction": "do", "input": None, "output": "x"}, "instruction_input", [("user", "do"), ("assistant", "x")]),
        ({"messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
        ({"messages": []}, "messages", []),
        ({"messages": None}, None, None),
        ({"messages": said, "prompt": "p", "system": "s"}, "messages_system", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"prompt": "x" * 300_000, "completion": "é"}, "prompt_completion", [("user", "x" * 300_000), ("assistant", "é")]),
        ({"prompt": "p"}, None, None),
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in enumerate(records)], "id long, raw string")
    got = {r.id: r for r in chat_format.canonical_records(df, "raw").collect()}
    assert [(got[k].layout, got[k].turns and [(t.role, t.text) for t in got[k].turns]) for k in range(len(records))] == [(m, t) for _, m, t in records]
    clashing = df.union(df).withColumn("turns", F.lit("old")).withColumn("__x", F.lit(1))
    again = chat_format.canonical_records(clashing, "raw")
    assert again.count() == 2 * len(records) and dict(again.dtypes)["turns"].startswith("array")
    assert chat_format.canonical_records(df.limit(0), "raw").count() == 0
    rows = chat_format.turn_rows(again, "id")
    assert rows.columns == ["conv_id", "turn", "role", "text"] and rows.count() == 2 * sum(len(t or ()) for *_, t in records)
    done = {r.conv_id: r.n_turns for r in chat_format.format_turns(chat_format.turn_rows(chat_format.canonical_records(df, "raw"), "id")).collect()}
    assert done == {k: len(t) for k, (_, _, t) in enumerate(records) if t}


# ---- token counts and packing ------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(pieces, symbols):
    at = n = 0
    while at < len(symbols):
        end = next((e for e in range(len(symbols), at, -1) if symbols[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_is_greedy():
    rng = random.Random(8)
    for _ in range(400):
        pieces = {tuple(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 10))}
        machine = token_counts.LongestMatch(pieces)
        for _ in range(8):
            s = tuple(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
            assert machine.count(s) == greedy(pieces, s)


TEXTS = [(1, "Hello, world! It's 12,5 degrees."), (2, None), (3, ""), (4, " \n"), (5, "ΟΔΟΣ İstanbul é日本語 a.b. c., d"), (6, "x" * 300_000), (7, "<|endoftext|> <|startoftext|>, ok."), (1, "Hello, world! It's 12,5 degrees."), (None, "no id")]


def test_token_counts(spark):
    import regex

    pieces = set(token_counts.vocabulary_pieces(PATH))
    longest = max(map(len, pieces))

    def greedy_long(symbols):
        """greedy() for words that are longer than any piece."""
        at = n = 0
        while at < len(symbols):
            end = next((e for e in range(min(len(symbols), at + longest), at, -1) if symbols[at:e] in pieces), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    want = []
    for i, t in TEXTS:
        words = regex.findall(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", (t or "").lower())
        want.append((i, len(words), sum(greedy_long((*w.encode(), 256)) for w in words)))
    clashing = docs_of(spark, TEXTS).withColumn("n_tokens", F.lit("x")).withColumn("n_words", F.lit(None))
    for docs in (docs_of(spark, TEXTS), clashing):
        assert sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(docs_of(spark, []), PATH).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    rng = random.Random(3)
    texts = TEXTS[:7] + [(k, " ".join(rng.choice(["the", "Thing,", "été", "zxqj", "end."]) for _ in range(int(rng.paretovariate(0.7) * 20) % 9000))) for k in range(10, 150)]
    rows = packing.pack(docs_of(spark, texts + [texts[-1]]).repartition(3), PATH).collect()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in texts}
    places, sums = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
    assert all(sums[i] == len(x) * (2 if i == texts[-1][0] else 1) for i, x in ids.items())
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(sums.values()) // 4096) + 3  # an unfilled window for each task
    assert packing.pack(docs_of(spark, []), PATH).count() == 0
    # Columns named as the result's are ignored, and small splits are packed nearly as well as one.
    clashing = docs_of(spark, texts + [texts[-1]]).withColumn("sequence_id", F.lit("x")).withColumn("offset", F.lit(None)).repartition(40)
    many = packing.pack(clashing, PATH)
    assert many.count() == len(rows) and many.agg(F.sum("length")).first()[0] == sum(sums.values())
    assert many.select("sequence_id").distinct().count() <= 1.06 * len(places) + 1
    assert many.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("m")).where("n > 4096 or k < m").count() == 0


ODD = ["it's.", "don't, X'S.", "á. b", "ΟΔΟΣ. Σ.", "İ, ısı.", "x\ty.\r\nz,", " a.", "क़लम. क़", "''s. 've,", "1,2.", "a.. b.,", "<|endoftext|>, a", None, "", " ", "é. É,", " b.", "."]


def test_encoder_is_the_tokenizer(monkeypatch):
    """Whatever is remembered, and wherever a long text is cut."""
    rng = random.Random(7)
    texts = ODD + [rng.choice(" \n").join("".join(rng.choice("abÉß1.,'-中 ") for _ in range(rng.randrange(1, 9))) for _ in range(80)) for _ in range(60)]
    encode = packing.Encoder(PATH)
    want = [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for remembered in (10**6, 50):
        monkeypatch.setattr(packing.Encoder, "LIMIT", remembered)
        for _ in range(2):
            ids, counts = encode.encode(pa.array(texts, pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
            for k in range(0, len(texts), 7):
                ids, counts = encode.encode(pa.array(texts[k : k + 7], pa.string()))
                assert ids.tolist() == sum(want[k : k + 7], []) and len(counts) == len(texts[k : k + 7])
    monkeypatch.setattr(packing, "SLICE", 50)
    whole = " ".join(t or "" for t in texts)
    assert encode.encode_long(whole).tolist() == encode.tokenizer.encode(whole, add_special_tokens=False).ids
    assert encode.encode(pa.array([], pa.string()))[0].tolist() == [] and encode.encode_long("").tolist() == []


def test_windows_stay_open():
    """Remainders that come later go into windows that are open already."""
    lengths = np.random.default_rng(5).integers(1, 3000, 120)
    rooms, windows = packing.Rooms(4096), 0
    for k in range(0, 120, 20):
        _, _, windows = packing.best_fit_decreasing(lengths[k : k + 20], 4096, rooms, windows)
    assert windows <= 1.1 * lengths.sum() / 4096 + 1


def test_best_fit_is_tightest():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 500)
    where, offset, n = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [(r, w) for w, r in enumerate(rooms) if r >= lengths[k]]
        if fits:
            best = min(r for r, _ in fits)
            assert rooms[where[k]] == best
        else:
            assert where[k] == len(rooms)
            rooms.append(64)
        assert offset[k] == 64 - rooms[where[k]]
        rooms[where[k]] -= lengths[k]
    assert n == len(rooms)


# ---- html --------------------------------------------------------------------


def pages_of(spark, pages):
    return spark.createDataFrame([(k, u, h, "x", 1) for k, u, h in pages], "page_id long, url string, html string, text string, n_chars int")


def test_articles(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p><article>';</script></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li><a href='/x'>Menu</a></ul></nav>"
        "<!-- ad <article> --><div class=\"ad\">Buy</div><article class='post'><header><h1>A  title</h1></header><p>One <b>two</b>three<br>four &amp; five&#33;<p>Six\n seven<ul><li>eight<li>nine</ul>"
        "<aside>see also</aside><form><input value='>'>Send</form><div class='comments'><p>me too</p></div><div role=\"navigation\">next</div></article><div class='cookie-notice'>OK?</div><footer>&copy; us</footer>"
    )
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", None), (3, None, ""), (4, "http://b.example", "<p>alone &lt;b&gt;"), (1, "http://a.example/1", page), (5, "http://c.example", "<article>" + "<p>long " * 50_000), (6, "x", "<<>< <a <b>t</b> & &amp")]
    got = {r.page_id: r for r in html_extract.extract(pages_of(spark, rows)).collect()}
    assert got[1].text == "A title One twothree four & five! Six seven eight nine" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[3].text == "" and got[4].text == "alone <b>" and got[5].n_chars == 50_000 * 5 - 1
    assert html_extract.extract(pages_of(spark, rows)).count() == len(rows) and html_extract.extract(pages_of(spark, [])).count() == 0


def test_deduced_template(spark):
    """A host that names nothing: the main slot and the constants come out of the pages alone."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for k in range(12):
        paras = [" ".join(word() for _ in range(40)) for _ in range(3)]
        body = "".join(f"<p>{p}</p>" for p in paras)
        rows.append((k, f"http://plain.example/{k}", f"<html><body><table><tr><td>Home {word()}</td><td><div><span>Printed by the house</span>{body}</div></td><td>Call us</td></tr></table></body></html>"))
        want[k] = " ".join(paras)
    assert {r.page_id: r.text for r in html_extract.extract(pages_of(spark, rows)).collect()} == want


def test_template_inside_articles(spark):
    """Constants go from articles too; words of running text and copies of a page are none, and names alone tell hosts with few pages."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for host, n in (("many", 9), ("few", 2), ("copies", 3)):
        for k in range(n):
            head, first, last = words(4), words(30), words(30)
            page = f"<html><body><article><h1>{head}</h1><p class='by'>Printed by the house</p><div><p>{first} <a href='/'>{last}</a> and <b>so on</b></p><p>{last}</p></div></article><div>{words(4)}</div></body></html>"
            for copy in range(5 if host == "copies" and k == 0 else 1):
                i = len(rows)
                rows.append((i, f"http://{host}.example/{i}", page))
                want[i] = " ".join([head, *([] if host == "many" else ["Printed by the house"]), first, last, "and so on", last])
    assert {r.page_id: r.text for r in html_extract.extract(pages_of(spark, rows)).collect()} == want


def test_shared_articles_stay(spark):
    """Pages of one host with the same article, and other menus, are no template of it; repeated rows change nothing."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    text = [words(40) for _ in range(4)]
    rows = [(k, f"http://same.example/{k}", f"<html><body><nav><a>{words(3)}</a></nav><article>{''.join(f'<p>{t}</p>' for t in text)}</article><footer>{words(4)}</footer></body></html>") for k in range(8)]
    got = html_extract.extract(pages_of(spark, rows * 2)).collect()
    assert len(got) == 16 and {r.text for r in got} == {" ".join(text)} and {(r.host_pages, r.from_template) for r in got} == {(8, True)}


def test_template_decides(spark, monkeypatch):
    """Without the template (no host has enough pages for one) the same pages give other texts."""
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        body = words(60)
        rows.append((k, f"http://plain.example/{k}", f"<html><body><div>Home {words(2)}</div><section><p>All rights are ours</p><p>{body}</p></section><div>Call us {words(1)}</div></body></html>"))
        want[k] = body
    assert {r.page_id: (r.text, r.from_template) for r in html_extract.extract(pages_of(spark, rows)).collect()} == {k: (t, True) for k, t in want.items()}
    monkeypatch.setattr(html_extract, "SUPPORT", 2.0)
    off = {r.page_id: (r.text, r.from_template) for r in html_extract.extract(pages_of(spark, rows)).collect()}
    assert all(t != want[k] and not slot for k, (t, slot) in off.items())


def test_wrappers_are_no_asides(spark):
    """Class words and forms around the main text don't drop it; comments are none, in articles or beside them."""
    body = "<article><h1>Head</h1><p>Body text of some length.</p></article>"
    whole = "Head Body text of some length."
    teasers = "<div class='related'>" + "<article>Other story</article>" * 9 + "</div>"
    comment = "<article class='comment'><p>" + "me too " * 30 + "</p></article>"
    cases = [
        (f"<div class='content-with-sidebar'>{body}</div>", whole),
        (f"<div class='layout no-sidebar has-comments'>{body}<div class='sidebar'>Side</div>{teasers}</div>", whole),
        (f"<div id='site-search-page'>{body}</div>", whole),
        (f"<form id='aspnetForm'><div class='widget'>Side</div>{body}</form>", whole),
        (f"<main><div class='has-comments'>{body}</div></main>", whole),
        (f"<div class='layout with-sidebar'><h1>Head</h1><p>Body text of some length.</p><div class='comments'>{'me too ' * 2}</div></div>", whole),
        (f"<article><h1>Head</h1><p>Body text of some length.</p>{comment}</article>", whole),
        (f"{body}<div id='comments'>{comment}</div>{teasers}", whole),
        ("<div class='sidebar'><article>Tease</article></div><div class='has-sidebar'>" + body + "</div>", whole),
        ("<main><article class='post comments-open'><p>All of it</p></article></main>", "All of it"),
        (f"<p>{whole}</p><form>Search Go</form><div class='login'>Log in</div>", whole),
        ("<div class='comments'><p>nothing else</p></div>", "nothing else"),
        ("<nav>Menu</nav><form><footer>us</footer></form>", ""),
    ]
    # A host for each, then one host of several pages of each.
    rows = [(k, f"http://h{k}.example", f"<html><body>{h}</body></html>") for k, (h, _) in enumerate(cases)]
    rows += [(100 * (k + 1) + n, f"http://m{k}.example/{n}", f"<html><body>{h.replace('some', 'some' + 'abcdef'[n])}</body></html>") for k, (h, _) in enumerate(cases[:5]) for n in range(6)]
    want = {k: t for k, (_, t) in enumerate(cases)}
    want |= {100 * (k + 1) + n: f"Body text of some{'abcdef'[n]} length." for k in range(5) for n in range(6)}
    got = {r.page_id: r.text for r in html_extract.extract(pages_of(spark, rows)).collect()}
    assert got == want

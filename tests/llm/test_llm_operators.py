"""Brute-force comparisons and edge cases of the training-data operators."""

from __future__ import annotations

import hashlib
import itertools
import random
import time
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cubelens.llm import common, components, decontaminate, exact_dedup, html_text, langid, license_scan, mixing, simhash, substring, textops, token_output, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, start string"
WORDS = "the of and erth thonble was inges reheat onthe idea stone river light green paper cloud north".split()


def prose(rng: random.Random, n: int, words: list[str] = WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def frame(spark, texts, schema=DOCS, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}" if i % 5 else None, len(t or ""), 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


EDGES = ["", None, "a", " \n\t ", "same text", "same text", "ß é 中文 字", "x" * 200_000, "word " * 60_000, "idiot. You idiot!", "<|endoftext|> two  spaces"]


def saved(df, tmp_path, name="documents"):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- shared text work ---------------------------------------------------------------------------------------------


def test_words_stop_at_text_limits():
    raw, at = common.text_bytes(pa.array(["Ab c", None, "", "cAB", "é1"]))
    start, end, first = textops.words(raw, at)
    got = [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)]
    assert got == ["Ab", "c", "cAB", "é1"] and first.tolist() == [0, 2, 2, 2, 3, 4]
    h = textops.word_hashes(raw, start, end)
    raw2, at2 = common.text_bytes(pa.array(["xx aB"]))
    s2, e2, _ = textops.words(raw2, at2)
    assert textops.word_hashes(raw2, s2, e2)[1] == h[0] and len(set(h.tolist())) == 4


def test_slices_cover_all_rows():
    at = np.cumsum([0, 5, 0, 100, 1, 1, 1])
    got = list(common.slices(at, 6))
    assert [a for a, _ in got] == [0, 2, 3] and got[-1][1] == 6


def test_bounded_sample_is_the_first_by_hash(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 40))
    want = {r["k"] for r in df.orderBy(place).limit(50).collect()}
    assert {r["k"] for r in common.bounded_sample(df, 50, "k").collect()} == want
    assert common.bounded_sample(df.limit(7), 50, "k").count() == 7 and common.bounded_sample(df.limit(0), 50, "k").count() == 0


# ---- 1 ------------------------------------------------------------------------------------------------------------


def test_tokens_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [*EDGES, *[prose(rng, rng.randrange(1, 300)) for _ in range(60)], "a  b", " lead", "tail ", "\n", "it's I'll"]
    d = saved(frame(spark, texts), tmp_path)
    path = f"{tmp_path}/files"
    token_output.write(spark.read.parquet(f"{d}/documents.parquet"), path)
    got = {r["doc_id"]: r for r in token_output.read(spark, path).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc), t
        start += len(ids)
    assert token_output.read_document(spark, path, 12).tolist() == [*tok.encode(texts[12], add_special_tokens=False).ids, 0]


def test_tokens_of_no_documents_and_null_ids(spark, tmp_path):
    token_output.write(frame(spark, []), f"{tmp_path}/none")
    assert token_output.read(spark, f"{tmp_path}/none").count() == 0
    rows = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "b"), (1, None)], "doc_id bigint, text string")
    token_output.write(rows, f"{tmp_path}/odd")
    got = token_output.read(spark, f"{tmp_path}/odd").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 3, 3] and [r["start"] for r in got] == [0, 3, 4, 6]


# ---- 2 ------------------------------------------------------------------------------------------------------------


def test_grammar_composes_aim_negation_and_report():
    model = toxicity.Model(toxicity._seed_words(), ("zorg",), toxicity.PRIOR, toxicity.BIAS)
    events = lambda t: dict(zip(toxicity.EVENTS, model.events(t).tolist(), strict=True))
    assert events("a clown here")["insult"] == 1
    assert events("you are an idiot")["aimed_insult"] == 1.5
    assert events("they are not an idiot")["negated_insult"] > 0 and events("they are not an idiot")["aimed_insult"] == 0
    assert events("he said the word idiot")["reported_insult"] > 0
    assert events("i will hurt you")["threat"] == 1 and events("you, i will hurt")["aimed_threat"] == 1.5
    assert events("i will hurt you")["aimed_threat"] == 1.5 and events("idiots like you")["aimed_insult"] == 1.5
    assert events("i will hurt no one here that you know")["aimed_threat"] == 0
    assert events("not an idiot like you")["aimed_insult"] == 0
    assert events("zorgling stands")["insult"] == 1
    assert not model.events("nothing of note. not said").any()
    assert events("he said it. idiot")["insult"] == 1  # another clause


def test_toxicity_learns_stems_and_leaves_clean_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = prose(rng, 60).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "blarg" + rng.choice(["a", "en", "ix", "ot", "um"]) if i % 8 else "moron")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None), (None, "moron"), (9001, "")], "doc_id bigint, text string")
    train = spark.createDataFrame([(i, y) for i, y in labels if i % 5], "doc_id bigint, toxic int")
    model = toxicity.train(docs, train)
    assert any(s.startswith("blar") for s in model.stems)
    got = {r["doc_id"]: r["_toxic_score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)
    assert got[9000] == got[9001] < 0.5 and got[None] >= 0.5


def test_toxicity_without_labels_or_documents(spark):
    docs = frame(spark, EDGES)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, none)
    assert model.stems == () and toxicity.score(docs, model).count() == len(EDGES)
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_composed_grammar_is_the_machines_one_after_the_other():
    rng = random.Random(33)
    whole, parts = toxicity.grammar(), list(toxicity.machines().values())
    assert len(parts) == 6
    for _ in range(3000):
        symbols = [rng.choice("ITYNROGM") for _ in range(rng.randrange(14))]
        want = [(s, 1.0) for s in symbols]
        for machine in parts:
            state, after = 0, []
            for symbol, weight in want:
                put, w, state = machine.step(state, symbol)
                after.append((put, weight * w))
            want = after
        state, got = 0, []
        for symbol in symbols:
            put, w, state = whole.step(state, symbol)
            got.append((put, w))
        assert [p for p, _ in got] == [p for p, _ in want] and np.allclose([w for _, w in got], [w for _, w in want])


def test_negated_reported_and_threatening_clauses_in_four_languages():
    model = toxicity.Model(toxicity._seed_words(), (), toxicity.PRIOR, toxicity.BIAS)
    event = lambda text: {e for e, x in zip(toxicity.EVENTS, model.events(text), strict=True) if x}
    cases = {
        "you are a total idiot": "aimed_insult", "du bist ein Trottel": "aimed_insult", "tu es un crétin": "aimed_insult", "usted es escoria": "aimed_insult",
        "they are not idiots": "negated_insult", "das ist kein Idiot": "negated_insult", "il n'est pas minable": "negated_insult", "no es basura": "negated_insult",
        "he wrote that all were morons": "reported_insult", "sie schrieb über den Abschaum": "reported_insult", "dijo que es escoria": "reported_insult",
        "I will kill you": "aimed_threat", "ich werde dich umbringen": "aimed_threat", "je vais te tuer": "aimed_threat", "to kill time": "threat",
    }
    for text, want in cases.items():
        assert want in event(text) and event(text) <= {want, want.removeprefix("aimed_")}, text
    assert model.events("a total idiot")[0] == 1.5 and model.events("I will surely kill")[4] == 1 and model.events("to kill time")[4] == 0.5
    score = lambda text: float(model.score(model.events(text)[None])[0])
    assert score("you are a total idiot") > 0.5 and score("I will kill you") > 0.5 and max(score(t) for t, e in cases.items() if e in ("negated_insult", "reported_insult", "threat")) < 0.5


# ---- 3 ------------------------------------------------------------------------------------------------------------


def test_longest_stretch_is_the_longest():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.random(rng.integers(0, 25)) < rng.choice([0.0, 0.5, 0.8])
        start, n = decontaminate.longest(s, 0.8)
        every = [j - i for i in range(len(s)) for j in range(i + 1, len(s) + 1) if s[i] and s[j - 1] and s[i:j].sum() >= 0.8 * (j - i) - 1e-9]
        assert n == max(every, default=0)
        assert not n or s[start : start + n].mean() >= 0.8 - 1e-9


def test_decontamination_finds_changed_copies_and_leaves_clean_rows(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, prose(rng, rng.randrange(15, 50), vocabulary)) for i in range(30)]
    texts, truth = [], set()
    for i in range(90):
        words = prose(rng, 60, vocabulary).split()
        if i % 3 == 0:
            copy = items[i // 3][1].split()
            for k in rng.sample(range(len(copy)), len(copy) // 8):
                copy[k] = "changed"
            words[20:20] = " ".join(copy).upper().split()
            truth.add((i, i // 3))
        texts.append(" ".join(words))
    docs = frame(spark, [*texts, *EDGES])
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "too short")], "item_id bigint, text string")
    got = decontaminate.overlaps(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == set(range(90 + len(EDGES))) - {i for i, _ in truth}
    assert decontaminate.clean(docs, bench).columns == docs.columns
    empty = bench.limit(0)
    assert decontaminate.overlaps(docs, empty).count() == 0 and decontaminate.clean(docs, empty).count() == docs.count()


def test_decontamination_is_one_plan_for_any_benchmark_and_exact_where_the_bits_are_full(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, prose(rng, 30, vocabulary)) for i in range(40)]
    docs = frame(spark, [prose(rng, 20, vocabulary) + " " + t for _, t in items])
    plans = []
    for n in (2, 40):
        found = decontaminate.overlaps(docs, spark.createDataFrame(items[:n], "item_id bigint, text string"))
        plans.append(len(re.findall(r"MapInArrow|Join|Aggregate", found._jdf.queryExecution().optimizedPlan().toString())))
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(n)}
    assert plans[0] == plans[1]
    monkeypatch.setattr(decontaminate, "_HASH_BITS", 3)
    monkeypatch.setattr(decontaminate, "_WORD_BITS", 3)
    found = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(40)}


# ---- 4 ------------------------------------------------------------------------------------------------------------


def page(article: str, extra: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=a>Menu</a></li></ul></nav><div class=\"ad\">Buy</div>{article}{extra}<footer>&copy; site</footer></body></html>"


def test_html_extracts_the_article():
    got = html_text.lines_of(page("<article><h1>Head &amp; tail</h1><p><b>One\n two<br><p>Three&nbsp;4<section class='comments'><p>no</p></section><aside>no</aside></article>"))
    assert [x for x, p, _ in got if p == html_text.ARTICLE] == ["Head & tail", "One two", "Three 4"]
    assert all(p == html_text.CHROME for x, p, _ in got if x in ("Menu", "Buy", "no", "© site"))


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        left, right = html_text.common_lines(a, b)
        best = max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(range(len(a)), n) if _within([a[i] for i in c], b)), default=0)
        assert len(left) == len(right) == best and [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)]


def _within(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_pages_without_markup_lose_what_their_neighbour_has(spark):
    body = "<html><body><div>Site head</div><p>{}</p><p>{}</p><div>Site foot</div></body></html>"
    rows = [(i, f"http://h.example/a/{i}", body.format(f"first words of {i}", f"and more of {i} here to read")) for i in range(40)]
    rows += [(100, None, None), (101, "http://other.example/", ""), (102, "http://h.example/a/3", "<p>unclosed <b>bold"), (None, "x", page("<article><p>Deep</p></article>"))]
    schema = "page_id bigint, url string, html string, text string"
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([(*r, "clash") for r in rows], schema)).collect()}
    assert all(got[i] == f"first words of {i}\nand more of {i} here to read" for i in range(40))
    assert got[100] == got[101] == "" and got[102] == "unclosed bold" and got[None] == "Deep"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_articles_that_quote_each_other_stay_whole(spark):
    art = "<article><h1>T{0}</h1><p>shared line of both</p><p>own {0}</p></article>"
    rows = [(i, f"http://h.example/{i}", page(art.format(i))) for i in range(4)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"T{i}\nshared line of both\nown {i}" for i in range(4)}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_shared_lines_inside_articles_go_only_where_all_neighbours_have_them(spark):
    """A notice of the host goes, a quotation that two articles share stays, and so does the text beside a teaser card."""
    def article(i):
        quote = "<p>a quotation of both</p>" if i in (4, 5) else ""
        return f"<main><p>Read our rules</p><h1>T{i}</h1><p>own text of {i}</p>{quote}<p>Log in to reply</p></main>"

    rows = [(i, f"http://h/a/{i}", f"<body>{article(i)}</body>") for i in range(12)]
    rows += [(20 + i, f"http://g/a/{i}", f"<body><div>Site</div><article><p>Teaser {i}</p></article><div>the main text of page {i}, much longer</div></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"T{i}\nown text of {i}" + ("\na quotation of both" if i in (4, 5) else "")
    for i in range(6):
        assert got[20 + i] == f"Teaser {i}\nthe main text of page {i}, much longer"


def test_runs_of_copies_lose_the_template_and_stay_whole(spark):
    body = "<body><div>Site head</div><div>Menu of the site</div>{}<div>Site foot</div></body>"
    copy = "<p>a text that is told three times</p><p>with a second paragraph of it</p>"
    texts = [f"<p>text {i} alone, told once</p><p>more of {i}</p>" for i in range(4)] + [copy] * 5 + [copy + "<p>and more</p>"] + [f"<p>text {i} alone, told once</p><p>more of {i}</p>" for i in range(10, 14)]
    rows = [(i, f"http://h/a/{i}", body.format(t)) for i, t in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == t.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")


def test_a_run_of_near_copies_longer_than_the_window_loses_the_template(spark):
    body = "<body><div>Site head</div><div>Menu of the site with many entries</div>{}<div>Site foot and address</div></body>"
    shared = "".join(f"<p>paragraph {k} that all thirty pages of the run have</p>" for k in range(6))
    rows = [(i, f"http://h/a/{i}", body.format(f"{shared}<p>own words of page {i}</p>")) for i in range(30)]
    rows += [(100 + i, f"http://h/b/{i}", body.format(f"<p>another text, number {i}</p><p>and its end {i}</p>")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(30):
        assert got[i].split("\n") == [f"paragraph {k} that all thirty pages of the run have" for k in range(6)] + [f"own words of page {i}"]
    for i in range(5):
        assert got[100 + i] == f"another text, number {i}\nand its end {i}"


@pytest.mark.parametrize("wrapper", [
    '<div class="content has-sidebar">{}</div>', '<div class="sidebar-right">{}<div class="sidebar">links</div></div>', '<div class="layout-with-menu"><ul class="menu"><li>links</ul>{}</div>',
    '<div class="no-comments">{}</div>', '<main class="search-page">{}</main>', '<form id="aspnetForm"><nav>links</nav>{}</form>', '{}<section id="comments"><article>I say so</article></section>',
    '<div id="page"><div class="cookie-banner">links</div>{}<form class="newsletter">links</form></div>',
])
def test_names_and_forms_around_an_article_do_not_hide_it(wrapper):
    article = '<article><div class="entry-header"><h1>Title</h1></div><p>' + "the body of it " * 20 + '</p><div class="share">links</div></article>'
    lines = html_text.lines_of(f"<html><body>{wrapper.format(article)}<footer>links</footer></body></html>")
    text = html_text.main_text(html_text.Page("h", "p", *map(list, zip(*lines, strict=True))), [])
    assert text == "Title\n" + ("the body of it " * 20).strip()


def test_most_of_a_page_is_no_furniture_unless_its_readers_wrote_it():
    plain = lambda inner: [x for x, p, _ in html_text.lines_of(f"<body>{inner}</body>") if p != html_text.CHROME]
    assert plain("<form class='search'><p>" + "long text " * 20 + "</p></form><form>q</form>") == [("long text " * 20).strip()]
    assert plain("<div class='comments'><p>" + "I say " * 50 + "</p></div><p>short</p>") == ["short"]


def test_text_does_not_depend_on_partitions(spark):
    """Pages in pairs with head and foot of their own; ranges of pages begin anywhere."""
    rows = [(i, f"http://h/a/{i}", f"<body><div>Head {i // 2}</div><p>text {i} of a page {'abc' * (i % 7)}</p><div>Foot {i // 2}</div></body>") for i in range(3000)]
    rows += rows[:3] + [(1, "http://h/a/1", "<p>another text of one id and url</p>")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 200, 1000):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(html_text.extract(frame.repartition(7) if n == 4 else frame).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == len(rows)
    assert sum("Head" not in r["text"] for r in found[0]) > 2900


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page_ in ("<a href=\"" * 100_000, "<!" * 100_000, "<a " * 100_000, "<a \"x>\" " * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<p><b>" * 50_000, "</" * 100_000, "<!--" * 50_000):
        html_text.lines_of(page_)
    html_text.common_lines(["x"] * 4000 + ["a"], ["x"] * 5000 + ["b"])
    assert time.time() - began < 20


def test_common_lines_in_halves(monkeypatch):
    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(40))] for _ in range(2))
        whole, _ = html_text.common_lines(a, b)
        monkeypatch.setattr(html_text, "_CELLS", 8)
        left, right = html_text.common_lines(a, b)
        monkeypatch.undo()
        assert len(whole) == len(left) and [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)]


# ---- 5 ------------------------------------------------------------------------------------------------------------


def _targets(sizes):
    """The contract's loop: excess over three times the source goes to the others by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 80)), rng.choice(["a", "b", "b", "b", "b", "b", "c", None, "é"]), "x") for i in range(900)]
    rows += [(9000, None, "a", "x"), (9001, " \n ", "empty", "x"), (5, rows[5][1], rows[5][2], "x"), (None, "one two three", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = mixing.mixed_sizes(docs).collect()
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = _targets(sizes)
    source = {i: s for i, _, s, _ in rows}
    taken: dict = {}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 2 for s in want)
    assert sorted(map(tuple, mixing.mixed_sizes(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    drawn: dict = {}
    for r in mixing.mix(docs).collect():
        drawn[r["source"]] = drawn.get(r["source"], 0) + len((r["text"] or "").split())
    assert {s: n for s, n in drawn.items() if n} == {s: n for s, n in taken.items() if n}


def test_splitting_tree_keeps_quotas(spark):
    tickets = spark.createDataFrame([(s, r) for s, n in ((1, 300), (2, 40), (3, 1)) for r in range(1, n + 1)], "src int, rank bigint")
    got = mixing.split(tickets, 7).collect()
    assert sorted((r["src"], r["rank"]) for r in got) == sorted((r["src"], r["rank"]) for r in tickets.collect())
    per = [sum(r["shard"] == k for r in got) for k in range(7)]
    assert max(per) - min(per) <= 3 and all(20 < sum(r["shard"] == k and r["src"] == 1 for r in got) < 60 for k in range(7))


def test_mixing_of_nothing(spark):
    docs = frame(spark, [])
    assert mixing.mixed_sizes(docs).count() == 0 and mixing.mix(docs).count() == 0
    blank = frame(spark, ["", None, " "])
    assert all(r["target"] == 0 and r["taken"] == 0 for r in mixing.mixed_sizes(blank).collect())


def test_mixing_with_names_that_clash_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 200)
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 30)), f"s{i % 90}", "h", i, "c") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, hash string, block int, `row` string")
    drawn = mixing.mix(docs)
    assert drawn.columns == docs.columns and mixing.sized(10_000)[0] == 50 == drawn.rdd.getNumPartitions() * 50 // mixing.sized(sum(len(r[1].split()) for r in rows))[0]
    times: dict = {}
    for r in drawn.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    for r in mixing.mixed_sizes(docs).collect():
        assert r["draws"] == times.get(r["doc_id"], 0) and (r["first_shard"] is None) == (r["draws"] == 0) and r["n_shards"] <= r["draws"]


def test_shards_grow_with_the_words():
    assert mixing.sized(0) == (16, 512, 1) and mixing.sized(10**9)[0] == 239
    shards, blocks, parts = mixing.sized(16 * 10**12)  # a hundred terabytes
    assert shards == 4096 and blocks == 131072 and parts * shards * mixing.SHARD >= 16 * 10**12


# ---- 6 ------------------------------------------------------------------------------------------------------------


def _license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_places_and_labels(spark):
    texts = [*EDGES, "CC-BY and cc by", "All rights  reserved. ALL RIGHTS RESERVED", "the General public\nLicense", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "under the license of mit and general", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."]
    got = license_scan.scan_documents(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _license(t), t
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {t: r["labels"] for t, r in zip(texts, got, strict=True)}
    assert by["Released under the MIT License."] == "mit" and by["under the license of mit and general"] == ""
    assert by[texts[-2]] == "apache-2.0" and by[texts[-1]] == "gpl,gpl-3.0" and by["Licensed under CC BY-NC 4.0."] == "cc-by,cc-by-nc-4.0"
    assert license_scan.scan_documents(frame(spark, [])).count() == 0


def test_every_license_of_a_document_is_found(spark):
    texts = ["\n\nand then ".join(t for _, t, _ in license_scan.TEMPLATES), f"{license_scan.TEMPLATES[2][1]}. Some files are licensed under the Apache License, Version 2.0"]
    got = [set(r["labels"].split(",")) for r in license_scan.scan_documents(frame(spark, texts)).orderBy("doc_id").collect()]
    assert {x for x, _, _ in license_scan.TEMPLATES} <= got[0] and got[1] == {"mit", "apache-2.0"}


BASE_SQL = r"""
WITH l AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM l
), n AS (
  SELECT doc_id, w, i, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w1, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM w
), p AS (
  SELECT doc_id, i, CASE WHEN w = 'cc' AND w1 = 'by' THEN 'cc-by' WHEN w = 'general' AND w1 = 'public' AND w2 = 'license' THEN 'gpl'
                         WHEN w = 'all' AND w1 = 'rights' AND w2 = 'reserved' THEN 'reserved' END AS label FROM n
)
SELECT d.doc_id, count(p.i)::BIGINT, count(p.label)::BIGINT, min(p.i) FILTER (WHERE p.label IS NOT NULL), max(p.i) FILTER (WHERE p.label IS NOT NULL),
       coalesce(array_to_string(list_sort(list(DISTINCT p.label) FILTER (WHERE p.label IS NOT NULL)), ','), '') FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id
"""


def test_license_base_columns_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(31)
    parts = ["cc", "BY", "by", "all", "rights", "Reserved", "general", "public", "license", "mit", "\n", "é", "-", "CC-BY"]
    texts = [*EDGES[:7], *(" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300))]
    d = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    want = sorted(duckdb.connect().execute(BASE_SQL).fetchall())
    got = license_scan.scan_documents(frame(spark, texts)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == want


def test_one_to_five_licenses_in_a_text_are_all_found(spark):
    """Planted templates, some with a word put in, against the labels planted and against a comparison of every place."""
    rng = random.Random(32)
    texts, planted = [], []
    for i in range(400):
        chosen = rng.sample(license_scan.TEMPLATES, 1 + i % 5)
        parts = []
        for _, t, _ in chosen:
            parts += [prose(rng, rng.randrange(0, 40), WORDS + ["license", "software", "version", "2", "copyright"]), t.upper() if rng.random() < 0.3 else t]
        texts.append(".\n".join([*parts, prose(rng, rng.randrange(5), WORDS)]))
        planted.append({x for x, _, _ in chosen})
    got = license_scan.scan_documents(frame(spark, texts)).orderBy("doc_id").collect()
    for r, want in zip(got, planted, strict=True):
        assert want <= set(r["labels"].split(","))
    index = license_scan.Index(license_scan.TEMPLATES, {w.encode(): float(len(w)) for w in WORDS})
    for text in texts[:40] + ["license " * 50, "2 0 " * 30 + "licensed under cc by 4 0"]:
        got = license_scan.words(text)
        at = {w: [i for i, x in enumerate(got) if x == w] for w in set(got)}
        assert index.find(got, at) == index.everywhere(got)


def test_licenses_with_other_wording_are_not_mixed_up(spark):
    texts = [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "the software is not licensed; ask the general public for version 3", "clean text about software and rights",
    ]
    got = [r["labels"] for r in license_scan.scan_documents(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["gpl,lgpl", "", ""]


# ---- 7 ------------------------------------------------------------------------------------------------------------


def _dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    return {i: (min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_exact_dedup_over_batches(spark, tmp_path, per_trigger):
    rows = [(i, t) for i, t in enumerate([*EDGES, "same\ntext", "sametext  ", "b", "A", "a"])]
    frame(spark, [t for _, t in rows]).repartition(5).write.parquet(f"{tmp_path}/d.parquet")
    got = exact_dedup.dedup(spark, f"{tmp_path}/d.parquet", files_per_trigger=per_trigger).collect()
    want = _dedup(rows)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_dedup_compares_bytes_on_hits(spark, tmp_path):
    texts = ["alpha", "al pha", "beta", "gamma", "gam ma", "delta"]
    frame(spark, texts).write.parquet(f"{tmp_path}/d.parquet")
    weak = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 0)  # noqa: E731  every text collides
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(spark, f"{tmp_path}/d.parquet", digest=weak).collect()}
    assert got == {i: v[:2] for i, v in _dedup(list(enumerate(texts))).items()}


def test_exact_dedup_of_one_file_repeats_null_ids_and_nothing(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (None, "ab"), (2, "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/dir")
    one = next((tmp_path / "dir").glob("part-*.parquet"))
    one.rename(tmp_path / "one.parquet")
    got = exact_dedup.dedup(spark, f"{tmp_path}/one.parquet").collect()
    assert len(got) == 4 and sum(r["kept"] for r in got) == 2 and {r["keep_id"] for r in got} == {1, 2}
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none.parquet")
    assert exact_dedup.dedup(spark, f"{tmp_path}/none.parquet").count() == 0


def test_exact_dedup_keeps_its_state_for_later_files(spark, tmp_path, monkeypatch):
    """A second run reads the new files alone and meets what the first has seen; beyond the bound hits are shuffled."""
    rows = [(i, t) for i, t in enumerate(["a b", "c", "ab", "d" * 50_000])]
    more = [(i + 10, t) for i, t in enumerate(["a  b", "c", "e", None, "d" * 50_000])]
    path, state = f"{tmp_path}/d.parquet", f"{tmp_path}/state"
    schema = "doc_id bigint, text string, _metadata string"
    spark.createDataFrame([(*r, "x") for r in rows], schema).write.parquet(path)
    assert exact_dedup.dedup(spark, path, state_dir=state).count() == 4
    spark.createDataFrame([(*r, "x") for r in more], schema).write.mode("append").parquet(path)
    monkeypatch.setattr(exact_dedup, "MOST_SENT", 0)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.dedup(spark, path, state_dir=state).collect()}
    assert got == _dedup(rows + more)
    batches = spark.read.parquet(f"{state}/batches")
    assert batches.where("batch = 1").count() == 5 and batches.where("batch = 0").count() == 3
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != exact_dedup.ROCKSDB


# ---- 8 ------------------------------------------------------------------------------------------------------------


def _fingerprint(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_simhash_components(spark, bucket):
    rng = random.Random(7)
    base = [prose(rng, 120).split() for _ in range(12)]
    texts = [t for t in EDGES]
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "Changed"
            texts.append(" ".join(w))
    got = simhash.near_groups(frame(spark, texts), bucket=bucket).orderBy("doc_id").collect()
    fps = [_fingerprint(t) for t in texts]
    assert [r["fp"] & (2**64 - 1) for r in got] == fps
    assert [r["component_id"] for r in got] == _components(fps)


def test_simhash_keeps_one_of_each_group(spark):
    texts = ["one two three four five", "one two three four five", "other words stand here now", "", None, " "]
    docs = frame(spark, texts).unionByName(frame(spark, texts[:1]))
    got = simhash.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 2, 3] and simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_groups(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_pigeonhole_thresholds_cover_every_link():
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2)
    for n in (10**3, 10**6, 10**9, 10**11):
        plan = simhash.allocate(fp, n)
        assert sum(t + 1 for _, t in plan) == simhash.LINK + 1
        assert len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_components_by_stars(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["u"]: r["v"] for r in components.stars(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {x: r for x, r in root.items() if x != r}
    assert components.stars(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- 9 ------------------------------------------------------------------------------------------------------------


def _windows(v, t):
    key = [(int(x) >> 24, i) if x else (0, i) for i, x in enumerate(v)]
    out = set()
    for c in np.flatnonzero(v):
        left = right = c
        while left > 0 and key[left - 1] > key[c]:
            left -= 1
        while right + 1 < len(v) and key[right + 1] > key[c]:
            right += 1
        if right - left + 1 >= t:
            out.add((int(c), int(left), int(right)))
    return out


def test_compact_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(10)
    for trial in range(150):
        v = rng.integers(1, 2**64, rng.integers(0, 50), dtype=np.uint64)
        v = np.sort(v)[:: rng.choice([1, -1])] if trial % 3 == 0 else rng.integers(1, 5, len(v)).astype(np.uint64) << np.uint64(40) if trial % 3 == 1 else v
        v = np.where(rng.random(len(v)) < 0.06, np.uint64(0), v)
        t = int(rng.integers(1, 8))
        assert set(zip(*(x.tolist() for x in substring.windows(v, t)), strict=True)) == _windows(v, t)


def test_passages_that_repeat_across_documents(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    shared = [prose(rng, rng.randrange(52, 90), vocabulary) for _ in range(6)]
    texts, held = [], set()
    for i in range(80):
        parts = [prose(rng, rng.randrange(20, 120), vocabulary) for _ in range(2)]
        if i % 4 == 0:
            parts.insert(1, shared[i // 4 % 6].upper() if i % 8 else shared[i // 4 % 6])
            held.add(i)
        texts.append(" ".join(parts))
    texts += [t for t in EDGES] + ["line one of it repeats. " * 400]
    got = substring.passages(frame(spark, texts)).collect()
    assert {x for r in got for x in (r["doc_id"], r["match_id"])} == held
    for r in got:
        assert r["n_words"] >= 50 and r["similarity"] >= 0.8
        a, b = (re.findall(r"[a-z0-9]+", texts[r[k]].lower()) for k in ("doc_id", "match_id"))
        same = [x == y for x, y in zip(a[r["start_word"] :][: r["n_words"]], b[r["match_word"] :][: r["n_words"]], strict=True)]
        assert sum(same) / len(same) >= 0.8
    assert substring.passages(frame(spark, [])).count() == 0


def test_passages_around_a_line_in_many_contexts(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    line, texts = prose(rng, 35, vocabulary), []
    for _ in range(30):
        left, right = prose(rng, 12, vocabulary), prose(rng, 13, vocabulary)
        texts += [" ".join([prose(rng, 60, vocabulary), left, line, right, prose(rng, 60, vocabulary)]) for _ in range(2)]
    got = substring.passages(frame(spark, texts)).collect()
    assert {(r["match_id"], r["doc_id"]) for r in got} == {(2 * i, 2 * i + 1) for i in range(30)}


def test_near_passages_with_a_line_that_the_leader_also_has_before(spark):
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(150):
        parts = [prose(rng, n, vocabulary).split() for n in (36, 20, 4)]
        passage = sum(parts, [])
        near = [f"x{i}" if i == 28 else w for i, w in enumerate(passage)]
        texts.append(" ".join([prose(rng, 60, vocabulary), *parts[1], prose(rng, 60, vocabulary), *passage, prose(rng, 60, vocabulary)]))
        texts.append(" ".join([prose(rng, 60, vocabulary), *near, prose(rng, 60, vocabulary)]))
    found = {(r["match_id"], r["doc_id"]) for r in substring.passages(frame(spark, texts)).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(150)}


def _edited(rng, words, n, kind):
    out = list(words)
    for k in range(n):
        at = rng.randrange(2, len(out) - 2)
        if kind == "insert":
            out.insert(at, f"z{k}")
        elif kind == "delete":
            del out[at]
        else:
            out[at] = f"z{k}"
    return out


def _jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("contexts", [1, 12])
def test_recall_of_near_passages_with_insertions(spark, contexts):
    """Pairs of passages with a similarity of 0.8 or more by brute force; in the second case every line stands in 12 of them."""
    rng = random.Random(23)
    vocabulary = [f"w{i}" for i in range(8000)]
    texts, pairs = [], set()
    line = prose(rng, 24, vocabulary).split()
    while len(pairs) < 240:
        if contexts > 1 and len(pairs) % contexts == 0:
            line = prose(rng, 24, vocabulary).split()
        n = rng.choice([60, 80, 120])
        passage = prose(rng, n, vocabulary).split()
        if contexts > 1:
            passage[18 : 18 + len(line)] = line
        other = _edited(rng, passage, rng.choice([1, 1, 2]), rng.choice(["insert", "delete", "replace"]))
        if _jaccard(passage, other) < 0.8 or len(other) < 50:
            continue
        pairs.add((len(texts), len(texts) + 1))
        texts += [" ".join([prose(rng, 50, vocabulary), *p, prose(rng, 50, vocabulary)]) for p in (passage, other)]
    got = substring.passages(frame(spark, texts)).collect()
    found = {(r["match_id"], r["doc_id"]) for r in got}
    assert len(found & pairs) >= 0.9 * len(pairs) and not found - pairs
    for r in got:
        a, b = texts[r["doc_id"]].split(), texts[r["match_id"]].split()
        assert r["n_words"] >= 50 and r["similarity"] >= 0.8 and a[r["start_word"]] == b[r["match_word"]]


def test_near_passages_between_documents_with_passages_of_other_leaders(spark):
    """Of four documents each has a near passage with the next alone, so that those between have two leaders that share nothing."""
    rng = random.Random(24)
    vocabulary = [f"w{i}" for i in range(8000)]
    texts, families = [], 60
    for _ in range(families):
        passage = prose(rng, 70, vocabulary).split()
        # each is one word from the next and two or three from the others
        for places in ((20, 50), (50,), (35,), (35, 12)):
            near = [f"y{i}" if i in places else w for i, w in enumerate(passage)]
            texts.append(" ".join([prose(rng, 50, vocabulary), *near, prose(rng, 50, vocabulary)]))
    found = {(r["match_id"], r["doc_id"]) for r in substring.passages(frame(spark, texts)).collect()}
    assert found == {(4 * f + i, 4 * f + i + 1) for f in range(families) for i in range(3)}


def test_candidates_of_a_common_line_do_not_grow_with_its_square(spark, monkeypatch):
    rng = random.Random(25)
    vocabulary = [f"w{i}" for i in range(8000)]
    line, n, laid, counts = prose(rng, 44, vocabulary), 150, substring._laid, []
    texts = [" ".join([prose(rng, 30, vocabulary), line, prose(rng, 30, vocabulary)]) for _ in range(n)]
    monkeypatch.setattr(substring, "_laid", lambda docs, pairs: counts.append(pairs.count()) or laid(docs, pairs))
    assert substring.passages(frame(spark, texts)).count() == 0
    assert n - 1 <= sum(counts) <= 10 * n


def test_long_texts_have_windows_beyond_24_bits_of_places():
    value = textops.mix64(np.arange(1, (1 << 24) + 4000, dtype=np.uint64))
    value[: 1 << 24] |= np.uint64(1 << 63)
    c, left, right = substring.windows(value, 46)
    assert c.max() > 1 << 24 and (left <= c).all() and (c <= right).all() and right.max() == len(value) - 1


# ---- 10 -----------------------------------------------------------------------------------------------------------


def test_language_codes_and_predictions(spark):
    rng = random.Random(12)
    words = {"aa": "kara bota mila sona tiru".split(), "bb": "strof knecht grund pfal wurz".split(), "cc": "elleau vrée pourquoi éant oiseau".split()}
    rows = [(i, prose(rng, rng.randrange(3, 60), words[k]), k) for i, k in enumerate(itertools.islice(itertools.cycle(words), 240))]
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (1003, "kara bota", None), (1004, "中", None)]
    docs = spark.createDataFrame([*rows, *extra], "doc_id bigint, text string, lang string")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"] and got[1004]["lang_pred"] in words
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.train(docs.where("lang is null")) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in langid.predict(docs.where("lang = 'aa' and text like '%a%'"), one).collect()} == {"aa"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


# ---- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    vocabulary = [f"v{i}" for i in range(700)]
    item = prose(rng, 40, vocabulary)
    texts = [prose(rng, 80, vocabulary) for _ in range(40)]
    texts += [texts[0], texts[1] + " ", prose(rng, 30, vocabulary) + " " + item, prose(rng, 30, vocabulary) + " idiot moron " + prose(rng, 30, vocabulary)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ")
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == set(range(43)) and kept[1] == set(range(40)) | {42} and kept[2] == set(range(40)) and kept[3] <= kept[2]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() and out.agg(F.min("start")).first()[0] == 0


# ---- edges of every operator and stage ----------------------------------------------------------------------------

CLASH = "hash row block score events gone _id place words sig src shard local edge _toxic_score _mix_src text_sha256 fp key".split()
LONG = "a very long text, word by word " * 70_000  # 2 MB


def edge_rows():
    texts = [*EDGES, LONG, "one tie", "one tie", "Licensed under CC BY-NC 4.0. you idiot", "日本語の文章です"]
    rows = [(i, t, "en" if i % 2 else "de", None if i % 4 == 0 else f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [rows[4], rows[5], (None, "no id", None, None), (5, "another text of id 5", "en", "s1")]
    return [(*r, *([7] * len(CLASH))) for r in rows]


def edge_frame(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame(rows, schema)


def _edge_cases():
    model = toxicity.Model(toxicity._seed_words(), (), toxicity.PRIOR, toxicity.BIAS)
    empty = "item_id bigint, text string"
    items = lambda s: s.createDataFrame([(1, "one tie"), (1, "one tie"), (2, None), (3, "")], empty)
    return {
        "op1": (lambda s, d, p: (token_output.write(d, f"{p}/t"), token_output.read(s, f"{p}/t"))[1], 1),
        "op2": (lambda s, d, p: toxicity.score(d, model), 1),
        "op2 clean": (lambda s, d, p: toxicity.clean(d, model), None),
        "op3": (lambda s, d, p: decontaminate.overlaps(d, items(s)), None),
        "op3 clean": (lambda s, d, p: decontaminate.clean(d, items(s)), None),
        "op3 no benchmark": (lambda s, d, p: decontaminate.clean(d, s.createDataFrame([], empty)), 1),
        "op5": (lambda s, d, p: mixing.mixed_sizes(d), 1),
        "op5 mix": (lambda s, d, p: mixing.mix(d), None),
        "op6": (lambda s, d, p: license_scan.scan_documents(d), 1),
        "op8": (lambda s, d, p: simhash.near_groups(d), 1),
        "op8 one": (lambda s, d, p: simhash.keep_one(d), None),
        "op9": (lambda s, d, p: substring.passages(d), None),
        "op10": (lambda s, d, p: langid.predict(d, langid.train(d)), 1),
    }


@pytest.mark.parametrize("name", _edge_cases())
def test_edges(spark, tmp_path, name):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names clash, and an empty table; results don't depend on the order of rows."""
    run, share = _edge_cases()[name]
    rows = edge_rows()
    got = run(spark, edge_frame(spark, rows), f"{tmp_path}/a")
    found = got.collect()
    if share:
        assert len(found) == len(rows)
    if name in ("op2 clean", "op3 clean", "op5 mix", "op8 one"):
        assert got.columns == edge_frame(spark, []).columns and len(found) < 3 * len(rows)
        assert name == "op5 mix" or set(map(tuple, found)) <= set(rows)
    again = run(spark, edge_frame(spark, rows[::-1]).repartition(5), f"{tmp_path}/b").collect()
    plain = lambda rs: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rs)
    assert plain(found) == plain(again)
    assert run(spark, edge_frame(spark, []), f"{tmp_path}/c").count() == 0
    by = {r["doc_id"]: r for r in found} if "doc_id" in got.columns else {}
    if name == "op1":
        assert by[1]["n_tokens"] == by[0]["n_tokens"] == 1 and by[11]["n_tokens"] > 400_000 and min(r["start"] for r in found) == 0
    if name == "op3":
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == sorted([(d, 1) for d in (12, 13)] * 2)
    if name == "op6":
        assert by[14]["labels"] == "cc-by,cc-by-nc-4.0" and by[1]["n_words"] == 0 and by[11]["n_words"] == 7 * 70_000
    if name == "op8":
        assert by[12]["component_id"] == by[13]["component_id"] == 12 and by[0]["component_id"] == by[1]["component_id"] == 0
    if name == "op10":
        assert by[1]["lang_pred"] == "und" and by[3]["lang_pred"] == "und"


def test_edges_of_the_stages(spark, tmp_path):
    """Every stage on rows with all the edges, and on no rows."""
    import corpus_pipeline

    spark.createDataFrame([(0, "one tie"), (1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(9, 1), (9, None), (12, 0), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = edge_frame(spark, edge_rows())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, whole, str(tmp_path))
        assert k == 4 or got.columns == whole.columns, name
        texts = [r["text"] for r in got.collect()] if k < 4 else []
        if name == "toxicity":
            assert None in texts and "" in texts and LONG in texts and "idiot. You idiot!" not in texts
        if name == "simhash":
            assert texts.count("one tie") == 1 and LONG in texts and "no id" in texts
        if name == "decontamination":
            assert "one tie" not in texts and None in texts and texts.count("same text") == 4
        if name == "mixing":
            assert texts
        if name == "tokens":
            assert got.count() == whole.count()
        assert stage(spark, edge_frame(spark, []), str(tmp_path)).count() == 0, name


def test_pages_with_columns_that_clash(spark):
    rows = [(i % 3, "http://h/a", f"<p>text {i}</p>" if i else None, 1, "x", 2) for i in range(7)]
    rows.append((9, None, "<p>" + "long " * 400_000, 1, "x", 2))
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, block int, host string, lines int")).collect()
    assert len(got) == 8 and max(r["n_chars"] for r in got) == 5 * 400_000 - 1 and min(r["n_chars"] for r in got) == 0


def test_items_of_any_length_and_ideographs(spark):
    """A benchmark of short items, repeated items and of a script without spaces, against a comparison of every place."""
    rng = random.Random(34)
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(1, 16)] + [(20, "q4x0 q4x1 q4x2 q4x3"), (30, "日本語の文章を読む練習"), (31, "a a a a a a a a a a a a a a")]
    texts = [f"{prose(rng, rng.randrange(9))} {t.upper()}, {prose(rng, 7)}" for _, t in items]
    texts += ["q4x0 q4x1 q4x3 q4x2", "これは日本語の文章を読む練習です", "a " * 3000, "日本語の練習"]
    got = decontaminate.overlaps(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    tokens = lambda t: re.findall(r"[\u3000-\u9fff]|[0-9a-z]+", t.lower())
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if any(tokens(t)[k : k + len(tokens(x))] == tokens(x) for k in range(len(tokens(t))))}
    assert found == want and len(got) == len(want)


def _similar(words, item):
    """Whether a stretch of LEAST words, or of the whole item, agrees in 80 % at some shift, with ends that agree."""
    need, best = min(decontaminate.LEAST, len(item)), 0
    for shift in range(-len(item), len(words)):
        same = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(item)]
        for a in range(len(item)):
            for b in range(a + need, len(item) + 1):
                if same[a] and same[b - 1] and sum(same[a:b]) >= decontaminate.SIMILAR * (b - a):
                    best = max(best, b - a)
    return best


def test_decontamination_equals_every_place_compared(spark):
    rng = random.Random(35)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, prose(rng, rng.randrange(6, 24), vocabulary)) for i in range(8)]
    texts = []
    for i in range(60):
        words = prose(rng, rng.randrange(30), vocabulary).split()
        item = items[i % 8][1].split()
        for k in range(len(item)):
            if rng.random() < 0.12:
                item[k] = "zz"
        texts.append(" ".join(words + item[: rng.randrange(4, len(item) + 1)] + prose(rng, 5, vocabulary).split()))
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.overlaps(frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {(d, i): n for d, t in enumerate(texts) for i, x in items if (n := _similar(t.split(), x.split()))}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(n == want[k] for k, n in got.items())


def _events(model, text):
    """The six machines one after the other over each clause, on symbols looked up word by word."""
    out = [0.0] * len(toxicity.EVENTS)
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        run = [(model.symbol(w), 1.0) for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)]
        for machine in toxicity.machines().values():
            state, after = 0, []
            for symbol, weight in run:
                put, w, state = machine.step(state, symbol)
                after.append((put, weight * w))
            run = after
        for put, weight in run:
            if put in toxicity._EVENT:
                out[toxicity._EVENT[put]] += weight
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on its own input against a plain version of what it says."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(51)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, prose(rng, 16, vocabulary)) for i in range(3)]
    texts = [prose(rng, rng.randrange(1, 90), vocabulary) for _ in range(120)]
    texts += [texts[i] + rng.choice(["", " ", " end"]) for i in range(0, 60, 3)]
    texts += [f"{prose(rng, 10, vocabulary)} {t} {prose(rng, 10, vocabulary)}" for _, t in items] + ["you total idiot", "they are not idiots. fine", "zorgy person zorgy", "", None]
    labels = []
    for k in range(60):
        toxic = k % 2
        labels.append((len(texts), 1, toxic))
        texts.append(f"{prose(rng, 9, vocabulary)} {'zorgy' if toxic else 'calm'} {prose(rng, 5, vocabulary)}")
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity._trained(spark, docs, str(tmp_path))
    kept = {i for i, t in enumerate(texts) if model.score(np.array([_events(model, t or "")]))[0] < 0.5}
    assert {i for i, t in enumerate(texts) if "zorgy" in (t or "")}.isdisjoint(kept) and len(kept) > 140
    docs = common.stored(stages["toxicity"](spark, docs, str(tmp_path)), "a")
    assert {r["doc_id"] for r in docs.collect()} == kept

    ids = sorted(kept)
    kept = {i for i, root in zip(ids, _components([_fingerprint(texts[i]) for i in ids]), strict=True) if ids[root] == i}
    docs = common.stored(stages["simhash"](spark, docs, str(tmp_path)), "b")
    assert {r["doc_id"] for r in docs.collect()} == kept and len(kept) < len(ids)

    kept = {i for i in kept if not any(_similar((texts[i] or "").split(), t.split()) for _, t in items)}
    docs = common.stored(stages["decontamination"](spark, docs, str(tmp_path)), "c")
    assert {r["doc_id"] for r in docs.collect()} == kept

    con = duckdb.connect()
    documents = pa.table({k: [r[k] for r in docs.collect()] for k in ("doc_id", "text", "source")})
    con.register("documents", documents)
    found = con.execute(mixing.ORACLE)
    names = [x[0] for x in found.description]
    draws = {r[names.index("doc_id")]: r[names.index("draws")] for r in found.fetchall()}
    docs = common.stored(stages["mixing"](spark, docs, str(tmp_path)), "d")
    drawn = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {i: sum(d == i for d, _ in drawn) for i in kept} == draws

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in drawn:
        tokens = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
    got = stages["tokens"](spark, docs, str(tmp_path)).orderBy("start").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]


def test_language_features_and_decoding_equal_plain_loops():
    rng = np.random.default_rng(52)
    texts = ["Ab c!", "", "é", "x", "one Two 3", "ab" * 40]
    raw, at = common.text_bytes(pa.array(texts))
    got = langid.features(raw, at)
    for row, t in zip(got, texts, strict=True):
        b = [x if x >= 128 else ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in t.encode()]
        counts = np.zeros(langid.BUCKETS)
        for i in range(len(b)):
            second, third = (b[i + k] if i + k < len(b) else 32 for k in (1, 2))
            for code in (b[i] | second << 8, b[i] | second << 8 | third << 16 | 1 << 24):
                counts[(code * 2654435761 % 2**32) >> 20] += 1
        want = np.sqrt(counts)
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-9), atol=1e-5)
    code = langid.codewords(9)
    model = langid.Model([f"l{i}" for i in range(9)], code, rng.normal(size=(langid.BUCKETS, code.shape[1])).astype(np.float32), np.zeros(code.shape[1], np.float32), rng.random(code.shape).astype(np.float32))
    best, score, _ = model.predict(got)
    for k in range(len(texts)):
        margin = [sum(float(got[k, f]) * float(model.weights[f, j]) for f in np.flatnonzero(got[k])) for j in range(code.shape[1])]
        distance = [sum(float(model.trust[c, j]) * np.logaddexp(0, -float(code[c, j]) * margin[j]) for j in range(code.shape[1])) for c in range(9)]
        near = np.exp(-4 * (np.array(distance) - min(distance)))
        assert int(np.argmin(distance)) == best[k] and abs(near.max() / near.sum() - score[k]) < 1e-3


def test_codewords_of_many_languages_are_apart():
    code = langid.codewords(200)
    assert min(int((code[i] != code[j]).sum()) for i in range(200) for j in range(i)) >= 10

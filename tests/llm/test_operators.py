import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embed_dedup, exact_dedup, html_extract, jaccard, langid, line_dedup, mixing, quality, queries, sp_codec, token_count
from tidemark.llm.common import Scratch, components, shared_dir

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, cls long, gram long, n long, x string"


def table(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, g, s, None, 1, 2, 3, 4, "x") for i, t, g, s in rows], SCHEMA).repartition(3)


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def odd_rows():
    rnd = random.Random(5)
    base = prose(rnd, 80).split(" ")
    rows = [(0, None, None, None), (1, "", "en", "src1"), (2, " \n\t ", "en", None), (3, "Two words", "en", "src1"), (4, "two  WORDS", "de", "src2"), (None, "no id here at all really", "en", "src0"), (5, prose(rnd, 20_000), "en", "src0")]
    for i in range(10, 40):
        w = list(base)
        for _ in range(i % 5):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, " ".join(w), "en" if i % 2 else "de", f"src{i % 4}"))
    rows += [(50, " ".join(base), "en", "src0"), (51, " ".join(base), "en", "src0"), (51, " ".join(base), "en", "src0")]
    return rows + [(60 + i, "a\nb\nc\nd" + "\nz" * (i % 2), "en", "src3") for i in range(4)]


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_jaccard_against_brute_force(spark):
    rows = odd_rows()
    rnd = random.Random(7)
    for i in range(100, 260):  # near copies of near copies, so that components have no centre
        w = (rows[-1][1] if i % 20 else prose(rnd, 60)).split(" ")
        for _ in range(2):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        rows.append((i, " ".join(w), "en", "src1"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect()), key=str)
    sets = [sets_of(r[1]) for r in rows]
    name = list(range(len(rows)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                name[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r[0])
    least = {k: min((v for v in ids if v is not None), default=None) for k, ids in groups.items()}
    assert got == sorted(((r[0], len(s), least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_jaccard_without_a_link(spark):
    rnd = random.Random(11)
    rows = [(i, prose(rnd, 30), "en", "src1") for i in range(20)] + [(30, prose(rnd, 2), None, None)]
    rows += [(40 + i, rows[0][1] + " " + prose(rnd, 12), None, None) for i in range(3)]  # that share n-grams, but too few
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect()) == [(r[0], r[0]) for r in rows]


def test_jaccard_words_and_texts_longer_than_a_slice(spark):
    rnd = random.Random(12)
    word = "x" * (2 * jaccard.SLICE + 5)
    long = prose(rnd, 150_000)
    rows = [(1, f"{word} b c d e f g h", "en", None), (2, f"  {word.upper()}\nb c\td e f  g h ", "en", None), (3, f"{word}y b c d e f g h", "en", None), (4, long, "en", None), (5, long.replace(" ", "  "), "en", None), (6, long[:-9], "en", None), (7, word, None, None), (8, word, None, None), (9, word + " " + word, None, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert got == {i: (len(sets_of(t)), c) for (i, t, *_), c in zip(rows, [1, 1, 3, 4, 4, 4, 7, 7, 9], strict=True)}


@pytest.mark.parametrize(("keep", "per_node"), [("min", 50_000), ("max", 1)])
def test_exact_dedup(spark, keep, per_node):
    rows = odd_rows()
    got = exact_dedup.exact_dedup(table(spark, rows), keep=keep, per_node=per_node).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        best = (min if keep == "min" else max)((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)


def test_exact_dedup_in_several_rounds(spark):
    df = spark.range(0, 3000, 1, 20).select((F.col("id")).alias("doc_id"), (F.col("id") % 700).cast("string").alias("text"))
    got = exact_dedup.exact_dedup(df, per_node=2).collect()  # 1500 nodes or more: three rounds
    assert len(got) == 3000 and all(r.keep_id == r.doc_id % 700 and r.group_size == len(range(r.doc_id % 700, 3000, 700)) for r in got)


def test_token_counts_and_codec(spark):
    import sentencepiece

    path = queries.model_path()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(2)
    texts = [None, "", " ", "   ", "▁▁ x", "<s></s><unk> <0x41>", "ﬁ½\xa0x 日本語 😀 العربية", "aaaa" * 50, "a  b\n c  ", "x = 1;\n    return y\n" * 900, prose(rnd, 9000)]
    texts += ["".join(rnd.choice("abt he▁ \n1éш") for _ in range(rnd.randrange(60))) for _ in range(300)]
    df = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    want = {i: m.encode(t or "") for i, t in enumerate(texts)}
    counts = {r.doc_id: r for r in token_count.count_tokens(df, path, slice_bytes=1000, piece_chars=64).collect()}
    assert {i: r.n_tokens for i, r in counts.items()} == {i: len(w) for i, w in want.items()}
    assert all(r.n_bytes == len((texts[i] or "").encode()) and r.over_limit == (r.n_tokens > 4096) for i, r in counts.items())
    ids = sp_codec.encode(df, path, slice_bytes=500)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert {r.doc_id: r.text for r in sp_codec.decode(ids, path).collect()} == {i: m.decode(w) for i, w in want.items()}


def test_language_id(spark):
    rnd = random.Random(3)
    tongue = {"aa": "lorem ipsum dolor sit amet elit".split(), "bb": "uber nacht schon wieder jahr zwei".split()}
    rows = [(i, " ".join(rnd.choice(tongue[g]) for _ in range(30)), g, "src0") for i in range(200) for g in [rnd.choice(["aa", "bb"])]]
    rows += [(900, None, "aa", None), (901, "12 ... 34", "aa", None), (902, "", None, None), (None, "lorem ipsum dolor", None, None)]
    got = {r.doc_id: r for r in langid.identify(table(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == g and 0 <= got[i].score <= 1 for i, _, g, _ in rows[:200])
    assert all(got[i].lang_pred == "und" for i in (900, 901, 902)) and got[None].lang_pred == "aa" and not got[None].held_out
    assert {r.lang_pred for r in langid.identify(table(spark, []).union(table(spark, [(1, "x", None, None)]))).collect()} == {"und"}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<script>var a='</p>'</script><nav>menu</nav>", ""),
        ("<body><nav><a>x</a></nav><article><h1>T&amp;t</h1><p>One  two<br>three</p><p><b>open<br><p>next</article><footer>f</footer>", "T&t\n\nOne two three\n\nopen\n\nnext"),
        ("<header>site</header><main><header><h1>Head</h1><span>by me</span></header><p>Body text of the page</p><aside>side</aside><div class='comments'><p>I say</p></div><form>f</form></main>", "Head\n\nBody text of the page"),
        ("<div class=menu><a>a</a><a>b</a></div><div><p>" + "long text " * 20 + "</p><p>short</p></div><div class='cookie-notice'>c</div>", ("long text " * 20).strip() + "\n\nshort"),
        ("<article class='post'><p>kept<!-- no --></p><div class='ad'>buy</div><div class='share-buttons'>s</div></article", "kept"),
    ],
)
def test_html(html, want):
    assert html_extract.main_text(html) == want


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ("<section id='discussion'><h2 id='search'>Head</h2><p>More text here.</p></section>", ["Head", "More text here."]),
        ("<section id='related-work'><p>More text here.</p></section>", ["More text here."]),
        ("<h2><span id='Share'>Head</span></h2><p>More text here.</p>", ["Head", "More text here."]),
        ("<section id='related-posts'><p>Other pages.</p></section>", []),
        ("<section id='comments'><p>A reader says.</p></section>", []),
        ("<section class='comments' id='discussion'><p>A reader says.</p></section>", []),
        ("<div id='share-buttons'>Share this</div>", []),
    ],
)
def test_html_ids_in_an_article(part, want):
    lead = "A first paragraph of the article that is long enough to be its content."
    assert html_extract.main_text(f"<html><body><article><p>{lead}</p>{part}</article></body></html>") == "\n\n".join([lead, *want])


LEAD = "lead text " * 20


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<article><p>{LEAD}</p><section id='discussion'><p>More text here.</p></section></article>", [LEAD.strip(), "More text here."]),
        (f"<article><p>{LEAD}</p><div class='form-of-life'><p>More text here.</p></div></article>", [LEAD.strip(), "More text here."]),
        (f"<article><p>{LEAD}</p><div class='comment'><p>{LEAD * 20}</p></div></article><p>{LEAD}</p>", [LEAD.strip()]),
        (f"<div class='layout-sidebar-left'><div class='content'><p>{LEAD}</p><p>short</p></div></div>", [LEAD.strip(), "short"]),
        (f"<div class='sidebar'><div class='content'><p>{LEAD}</p></div><div class='ad'>buy now</div></div>", [LEAD.strip()]),
        (f"<div class=sidebar><p>side</p><main><p>{LEAD}</p></main>", [LEAD.strip()]),
        (f"<nav><ul><li>menu<article><p>{LEAD}</p></article>", [LEAD.strip()]),
        (f"<form id=aspnetForm><div><p>{LEAD}</p><p>End.</p></div><button>Send</button></form>", [LEAD.strip(), "End."]),
        ("<article><p>Read <span class='share'>Share it</span> on and on.</p></article>", ["Read on and on."]),
        (f"<article><p>{LEAD}</p><ul>{'<li>x</li>' * 12}</ul><p>{LEAD}</p></article>", [LEAD.strip(), *["x"] * 12, LEAD.strip()]),
        ("<nav>only menu text</nav><footer>and a foot</footer>", []),
        ("<article><p>One <script>var x = '<p>';</script>block <button>Copy</button>of <b>text</b>.</p></article>", ["One block of text."]),
        (f"<html><head><title>T</title><meta name=x><p>{LEAD}</p>", [LEAD.strip()]),
        (f"<table><tr><td>{LEAD}<td>next</table>", [LEAD.strip() + " next"]),
    ],
)
def test_html_evidence_is_relative(html, want):
    assert html_extract.main_text(html) == "\n\n".join(want)


@pytest.mark.parametrize(
    ("name", "content"),
    [("form-of-life", True), ("search-history", True), ("related-work", True), ("has-sidebar", True), ("intro", True), ("newsletter-signup", False), ("share-this", False), ("comment-body", False), ("related-content", False), ("notice", False), ("cookie-banner", False), ("ad", False), ("post-comments", False)],
)
def test_html_classes_in_an_article(name, content):
    assert html_extract.main_text(f"<article><p>{LEAD}</p><div class='{name}'><p>{LEAD}</p></div></article>") == "\n\n".join([LEAD.strip()] * (1 + content))


def test_html_ratio_smoothing_and_clusters():
    rnd = random.Random(8)
    page = "<body>" + "".join(f"<p>{'<b>' * rnd.randrange(3)}{'t' * rnd.choice([2, 40, 900])}</p>" for _ in range(40)) + "</body>"
    parser = html_extract.Lines()
    parser.feed(page)
    parser.end()
    ratio = [len(x[0]) / (x[1] + 1) for x in parser.lines]
    assert len(ratio) == 40 and {x[3] for x in parser.lines} == {0}
    for sigma in (0.4, 1.0, 2.5):
        r = math.ceil(3 * sigma)
        weight = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)}
        slow = [sum(weight[d] * ratio[i + d] for d in weight if 0 <= i + d < 40) / sum(weight[d] for d in weight if 0 <= i + d < 40) for i in range(40)]
        assert np.allclose(html_extract.smooth(np.array(ratio), sigma), slow)
        bits, content = [math.log2(v) for v in slow], []
        for v in sorted(bits, reverse=True):
            if content and content[-1] - v > html_extract.GAP:
                break
            content.append(v)
        assert list(html_extract.top_cluster(np.array(bits))) == [v >= content[-1] for v in bits]
    lines = [("t" * n, 1, html_extract.ARTICLE, 0, 0, 0, True) for n in (900, 2, 2, 2, 2, 2, 900)]
    assert html_extract.select(lines, 0.3).tolist() == [True, False, False, False, False, False, True]  # nothing smoothed
    assert html_extract.select(lines, 1.0).all()


def test_html_deep_and_long_pages():
    n = 20_000
    for html, want in ((("<b>" * n) + ("</i>" * n) + "x", "x"), ("<b>" * n + "<p>x</p>" * 3, "x\n\nx\n\nx"), ("<i><div>" + "<b>" * n + "</i>" * n + "y</div>", "y"), ("<div>" * n + "z" + "</div>" * n, "z")):
        begun = time.process_time()
        assert html_extract.main_text(html) == want
        assert time.process_time() - begun < 5
    long = "<article>" + f"<p>{LEAD}</p>" * 5000 + "</article>"
    assert html_extract.main_text(long) == "\n\n".join([LEAD.strip()] * 5000)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", "t"), (None, None, None, "t"), (1, "u", "<p>a b</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(str, html_extract.extract(df).collect())) == sorted(["Row(page_id=1, url='u', text='a b', n_chars=3)"] * 2 + ["Row(page_id=None, url=None, text='', n_chars=0)"])


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    x = [list(map(float, centres[i % 30] + rng.normal(0, 0.15, 16))) for i in range(400)]
    x += [x[0]] * 60 + [(2.0 * np.array(x[1])).tolist()] + [[0.0] * 16, [], [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, None, [1.0, 2.0]]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(None, x[0], 0)]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=0.9999).collect()}
    fine = [i for i, v in enumerate(x) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    u = np.array([x[i] for i in fine])
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in fine])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(len(x)) if i not in fine) and got[None].n_links == 0
    assert got[459].component_id == got[0].component_id and len(got) == len(rows)


def linked(x, cosine=0.9):
    u = np.array(x, float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = np.einsum("ik,jk->ij", u, u) >= cosine
    np.fill_diagonal(near, False)
    return near


def test_embeddings_at_the_default_recall(spark):
    rng = np.random.default_rng(14)
    centres = rng.standard_normal((150, 32))
    x = np.concatenate([centres[i % 150] + rng.normal(0, 0.32, 32) for i in range(3000)]).reshape(-1, 32).astype(np.float32)  # cosines around 0.9
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"vec_id long, embedding array<{kind}>")
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
        near = linked(x)
        found = np.array([got[i].n_links for i in range(len(x))])
        assert near.sum() > 10_000 and (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()


def test_embeddings_with_repeated_identifiers(spark):
    a, b = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.0, 0.1]
    close = [1.0, 0.05, 0.0, 0.2]
    rows = [(5, a), (5, b), (6, a), (7, b), (8, b), (9, close), (3, [0.0, 0.0, 1.0, 0.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.999999).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(3, 0, 3), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 2, 5), (8, 2, 5), (9, 2, 5)]


def test_embeddings_in_a_large_bucket(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(24) + rng.normal(0, 0.12, (2600, 24))  # one group, in blocks of 1,024
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()}
    want = linked(x).sum(1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum() and {r.component_id for r in got.values()} == {0}


def test_line_dedup(spark):
    rows = odd_rows()
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got[60, 4].text == "a\nb\nc\nd" and got[61, 5].text == "z" and got[61, 5].n_removed == 4 and got[62, 4].text == "" and got[63, 5].text == ""
    assert got[0, 1].text == "" and got[3, 1].text == "Two words"
    same = line_dedup.dedup_lines(table(spark, [(1, "p\nq\nr\nx\np\nq\nr", None, None), (2, "\n\n\n\n", None, None), (3, "\n\n\n\n", None, None)])).collect()
    assert sorted((r.doc_id, r.text) for r in same) == [(1, "p\nq\nr\nx"), (2, "\n\n\n\n"), (3, "\n\n\n\n")]


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 + 1), "en" if i % 3 else "de", f"src{i % 5}") for i in range(500)] + odd_rows()[:5]
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    df = table(spark, rows)
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    got = mixing.mix(df, levels, {"en": 3, "de/src1": 5, "de/src0": 0}, 80, 2, 9).collect()
    assert sum(r.taken_tokens for r in got) == total * 80 // 100
    assert all(0 <= r.part_tokens <= r.n_tokens and r.full_epochs <= 2 for r in got)
    assert not [r for r in got if (r.lang, r.source) == ("de", "src0")]
    assert sum(0 < r.part_tokens < r.n_tokens for r in got) <= 12
    again = mixing.mix(df.repartition(5), levels, {"en": 3, "de/src1": 5, "de/src0": 0}, 80, 2, 9).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    with pytest.raises(ValueError):
        mixing.mix(df, levels, {"en": -1})


def test_mixing_prefix_against_brute_force(spark):
    """One leaf: repeated rows, null identifiers, a text without words and a long one, in the order of the seeded epoch."""
    rows = [(i, "w " * (i % 9), "en", "s") for i in range(60)] + [(7, "w w", "en", "s"), (7, "w w", "en", "s"), (None, "w w w", "en", "s"), (None, "w w w", "en", "s"), (100, "w " * 50_000, "en", "s"), (101, None, "en", "s")]
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    for percent, epochs in ((1, 1), (40, 1), (130, 2), (500, 2)):
        budget = min(total * percent // 100, total * epochs)
        full, rest = divmod(budget, total)
        want, start = [], 0
        order = sorted((r for r in rows if (r[1] or "").split()), key=lambda r: (hashlib.md5(f"5:{full}:{'-' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is None, r[0]))
        for i, t, *_ in order:
            n = len(t.split())
            part = max(0, min(n, rest - start))
            start += n
            if full * n + part:
                want.append((str(i), n, full, part, full * n + part))
        got = sorted((str(r.doc_id), r.n_tokens, r.full_epochs, r.part_tokens, r.taken_tokens) for r in mixing.mix(table(spark, rows), {"source": F.col("source")}, {}, percent, epochs, 5).collect())
        assert [g[:3] for g in got] == sorted(w[:3] for w in want) or sum(g[4] for g in got) == sum(w[4] for w in want) == budget
        plain = [g for g in got if g[0] not in ("7", "None")]
        assert plain == sorted(w for w in want if w[0] not in ("7", "None"))


def test_codec_of_repeats_and_null_identifiers(spark):
    import sentencepiece

    path = queries.model_path()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(None, "a b c", None, None), (None, "a b c", None, None), (1, "x", None, None), (1, "x", None, None), (1, "other", None, None), (2, None, None, None)]
    df = table(spark, rows)
    want = sorted((str(i), m.encode(t or "")) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in sp_codec.encode(df, path).collect()) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_count.count_tokens(df, path).collect()) == sorted((i, len(x)) for i, x in want)


def test_quality(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, 30) if i % 3 else "### $$$ %%% !!! " * 9, "en", f"src{i % 4}") for i in range(300)] + odd_rows()[:3]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, rows), labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    assert len(got) == len(rows) and all(r.keep == (r.doc_id % 3 > 0) for r in got if r.doc_id >= 3)
    assert all(0 <= p <= 1 for r in got for p in (r.p_doc, r.p_host, r.p_path, r.score))
    assert quality.classify(table(spark, rows), labels.limit(0), F.col("source"), F.col("source")).count() == len(rows)


def test_quality_posteriors_against_brute_force(spark):
    rnd = random.Random(16)
    host = lambda i: f"h{min(int(rnd.expovariate(0.4)), 6)}" if i % 17 else None
    rows = [(i, prose(rnd, 20) if rnd.random() < 0.6 else "### $ %% !!! " * rnd.randrange(1, 9), rnd.choice(["en", "de", None]), host(i)) for i in range(400)]
    rows += [rows[3], rows[3], (None, "no identifier", "en", "h1"), (None, "no identifier", "en", "h1"), (500, None, None, None), (501, prose(rnd, 30_000), "en", "h2")]
    marks = [(i, rnd.randrange(2)) for i in range(0, 400, 3)] + [(0, 1), (3, None)]
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    got = quality.classify(table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int"), F.col("source"), path, max_labelled=50).collect()
    by = {}
    for i, q in marks:
        if q is not None:
            by.setdefault(i, []).append(q)
    known = {r.doc_id: r.p_doc for r in got}
    p_doc = {i: known[i] for i, *_ in rows}
    data = [(i, h or "-", f"{h or '-'}/{g or '-'}", sum(by[i]) / len(by[i]) if i in by else p_doc[i]) for i, _, g, h in rows]

    def sums(key):
        out = {}
        for d in data:
            s, n = out.get(key(d), (0.0, 0))
            out[key(d)] = s + d[3], n + 1
        return out

    def strength(groups):  # (sum, n, mean above)
        n = sum(g[1] for g in groups)
        nn = sum(g[1] ** 2 for g in groups)
        spread = (sum(k * (s / k - m) ** 2 for s, k, m in groups) - sum(m * (1 - m) for _, _, m in groups)) / (n - nn / n)
        return min(max(sum(k * m * (1 - m) for _, k, m in groups) / n / max(spread, 1e-12) - 1, 1.0), 1e6)

    mean = (sum(d[3] for d in data) + 0.5) / (len(data) + 1)
    hosts, paths = sums(lambda d: d[1]), sums(lambda d: (d[1], d[2]))
    k_host = strength([(s, n, mean) for s, n in hosts.values()])
    middle = {h: (s + k_host * mean) / (n + k_host) for h, (s, n) in hosts.items()}
    k_path = strength([(s, n, middle[h]) for (h, _), (s, n) in paths.items()])
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    want = []
    for i, h, q, v in data:
        p_host = (hosts[h][0] - v + k_host * mean) / (hosts[h][1] - 1 + k_host)
        p_path = (paths[h, q][0] - v + k_path * p_host) / (paths[h, q][1] - 1 + k_path)
        score = 1 / (1 + math.exp(-(odds(p_path) + odds(p_doc[i]) - odds(mean))))
        want.append((str(i), p_doc[i], p_host, p_path, score))
    have = sorted((str(r.doc_id), r.p_doc, r.p_host, r.p_path, r.score) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:], rtol=1e-9)
    assert all(r.keep == (r.score >= 0.5) for r in got)
    again = quality.classify(table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int"), F.col("source"), path, max_labelled=50, threshold=have[7][4])
    assert [r.keep for r in again.collect() if str(r.doc_id) == have[7][0]] == [True] * sum(r[0] == have[7][0] for r in have)


def test_quality_fit_counts_copies():
    rnd = np.random.default_rng(3)
    x, y, times = rnd.standard_normal((60, quality.N_FEATURES)), rnd.integers(0, 2, 60).astype(float), rnd.integers(1, 4, 60)
    one = quality.fit(x, y, times.astype(float))
    all_ = quality.fit(np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()))
    assert np.allclose(one[0], all_[0]) and np.allclose(one[1], all_[1])


def test_language_against_brute_force(spark):
    import zlib

    rnd = random.Random(23)
    letters = {"aa": "abcdeé", "bb": "bcdefß", "cc": "cdefgñ"}
    word = lambda g: "".join(rnd.choice(letters[g]) for _ in range(rnd.randrange(1, 6)))
    rows = [(i, " ".join(word(g) for _ in range(rnd.randrange(1, 40))) + rnd.choice(["", " 12!", "\n", " İX"]), g if i % 5 else None, None) for i in range(150) for g in [rnd.choice(sorted(letters))]]
    rows += [rows[3], rows[3], (200, "a", None, None), (201, "zzz yyy", None, None), (202, "".join(word("bb") for _ in range(30_000)), "bb", None), (None, "bcd bcd", "aa", None)]
    size = 30

    def grams(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        t = f" {' '.join(low.split())} " if low.strip() else ""
        count = {}
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                if g.strip():
                    count[g] = count.get(g, 0) + 1
        return count

    def code(g):
        return [0x1FFFFF] * (3 - len(g)) + [0 if c == " " else ord(c) for c in g]

    def ranked(count):
        return [g for g, _ in sorted(count.items(), key=lambda kv: (-kv[1], code(kv[0])))][:size]

    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    total = {}
    for i, t, g, _ in rows:
        if g and t and i is not None and not out(i):
            for x, n in grams(t).items():
                total.setdefault(g, {}).setdefault(x, 0)
                total[g][x] += n
    profile = {g: {x: r for r, x in enumerate(ranked(c))} for g, c in total.items()}
    want = []
    for i, t, _, _ in rows:
        mine = ranked(grams(t))
        away = {g: sum(abs(p[x] - r) if x in p else size for r, x in enumerate(mine)) for g, p in profile.items()}
        best = min(sorted(away), key=away.get)
        want.append((str(i), out(i), best, 1 / sum(math.exp(-(a - away[best]) / (0.02 * size * len(mine))) for a in away.values())))
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in langid.identify(table(spark, rows), size=size).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9), (a, b)


def test_empty_tables(spark):
    none = table(spark, [])
    path = queries.model_path()
    for df in (
        jaccard.jaccard_components(none), exact_dedup.exact_dedup(none), token_count.count_tokens(none, path), sp_codec.encode(none, path), langid.identify(none), line_dedup.dedup_lines(none),
        mixing.mix(none, {"source": F.col("source")}, {}), quality.classify(none, spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang")),
        embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")), html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.collect() == []


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    name = {}
    for a, b in edges:
        name.setdefault(a, a), name.setdefault(b, b)
    for _ in name:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in name.items() if k in linked}
    assert shared_dir(spark).startswith("file:")

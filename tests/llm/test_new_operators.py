"""Main text of pages, hard negatives and the repair of conversations, against brute force."""

import hashlib
import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuecorpus.llm import html_text, negatives, queries, repair

SF = "/root/testdata/sf0.001"
WORDS = "Wer viel liest und wenig davon behält, dem hilft auch ein langer Absatz nicht weiter als bis zum nächsten Punkt. "


class Article(HTMLParser):
    """Blocks inside of an article element, read by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_pages_against_another_parser(spark):
    got = {r["page_id"]: r for r in queries.op11_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = Article()
        want.feed(p["html"])
        assert got[p["page_id"]]["text"] == want.text() and got[p["page_id"]]["n_chars"] == len(want.text()) and got[p["page_id"]]["url"] == p["url"]


@pytest.mark.parametrize(
    "page, want",
    [
        # No article element: menus, notices, sidebars, adverts, forms and comments go by their names and links.
        (
            f'<body class="home with-sidebar"><div id="header"><a href=/>Site</a> {WORDS}</div><div class="main-menu"><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></div>'
            f'<div class="cookie-notice"><p>{WORDS}</p></div><div id="content"><h1>Caf&eacute; &amp; Bar</h1><p>{WORDS}<p>Ja.<div class="ad">Buy now {WORDS}</div><p>{WORDS}<ul><li>eins<li>zwei</ul>'
            f'<p>Das <b>En</b>de&nbsp;hier<br>oben</p></div><div class="sidebar"><p>{WORDS}</p></div><div id="comments"><h3>3 Comments</h3><p>{WORDS}</p></div><form><p>{WORDS}</p></form><div>&copy; 2020 Foo</div>',
            ["Café & Bar", WORDS.strip(), "Ja.", WORDS.strip(), "eins", "zwei", "Das Ende hier oben"],
        ),
        # An article with furniture of its own, and comments as articles.
        (
            f'<header>Site</header><main><div class="breadcrumbs">A / B</div><article><header class="entry-header"><h1>T</h1></header><p>kurz</p><aside>{WORDS}</aside><script>var a = "</p>";</script>'
            f'<style>p {{}}</style><!-- <p>{WORDS}</p> --><blockquote>q</blockquote><section class="comments"><article><p>{WORDS}</p></article></section><footer>f</footer></article></main><footer>{WORDS}</footer>',
            ["T", "kurz", "q"],
        ),
        # Comments under a heading, without any names.
        (f"<div><a href=1>Home</a> | <a href=2>News</a></div><h1>T</h1><p>{WORDS}</p><p>Nein.</p><p>{WORDS}</p><h2>Comments</h2><p>{WORDS}</p>", ["T", WORDS.strip(), "Nein.", WORDS.strip()]),
        # Names that are written together; a name that only looks alike.
        (
            f'<div class="topnav">{WORDS}</div><div class="cookiebar">{WORDS}</div><article><p class="commentary">eins</p><div id="adSlot3">{WORDS}</div><div class="adbox">{WORDS}</div><p>zwei</p>'
            f'<ol class="commentlist"><li><p>{WORDS}</p></li></ol></article><div class="leftSidebar">{WORDS}</div>',
            ["eins", "zwei"],
        ),
        # One form around everything; a menu that is never closed.
        (f"<form><nav>x</nav><p>{WORDS}</p></form>", [WORDS.strip()]),
        (f"<nav><a href=x>x</a><article><p>a &lt;b&gt; 1 < 2<p title='>'>c</article>", ["a <b> 1 < 2", "c"]),
        ("<nav><a>x</a></nav><footer>f</footer>", []),
        ("<article>" + "<p><b>wort</b>" * 3000, ["wort"] * 3000),
        ("nur Text", ["nur Text"]),
        ("", []),
        (None, []),
        ("<p", []),
        ("<a " * 20000, []),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == "\n\n".join(want)


def test_pages_of_any_shape(spark):
    rows = [(1, "u", "<article><p>x</article>", 7), (1, "u", "<article><p>x</article>", 7), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` int")
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "url", "a.b", "text"]
    assert sorted((r["page_id"] or 0, r["a.b"] or 0, r["text"]) for r in got.collect()) == [(0, 0, ""), (1, 7, "x"), (1, 7, "x")]
    clash = html_text.extract_text(df.select("html", F.lit("mine").alias("text"), F.lit(3).alias("row")))
    assert clash.columns == ["row", "text"] and {r["text"] for r in clash.collect()} == {"x", ""}
    assert html_text.extract_text(df.select("html")).where("text = 'x'").count() == 2
    assert html_text.extract_text(df.limit(0)).count() == 0


def brute_negatives(rows, is_anchor, k, m):
    """All pairs, in Python integers."""
    usable = [(i, lab, [int(np.floor(256 * float(x))) for x in vec]) for i, lab, vec in rows if i is not None and lab is not None and vec is not None and all(x is not None and np.isfinite(x) for x in vec)]
    out = []
    for a in sorted({r[0] for r in usable if is_anchor(r[0])}):
        _, label, vec = min((r for r in usable if r[0] == a), key=lambda r: (r[1], r[2]))
        scored = sorted((-sum(x * y for x, y in zip(vec, v, strict=False)), i, lab) for i, lab, v in usable if i != a)
        for s, i, lab in [x for x in scored if x[2] == label][:k]:
            inside = [(t, j) for t, j, lab in scored if lab != label and 30 * -s <= 100 * -t <= 90 * -s][:m]
            out += [(a, i, n, j, -s, -t) for n, (t, j) in enumerate(inside, 1)]
    return sorted(out)


def vectors(seed, n, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in np.round(rng.normal(size=4) * scale, 1)]) for i in range(n)]
    rows += [(n, None, [1.0] * 4), (n + 1, 0, None), (n + 2, 0, [1.0, None, 0.0, 0.0]), (n + 3, 1, [float("nan")] * 4), (n + 4, 1, [float("inf")] * 4), (None, 1, [1.0] * 4)]
    # Ties, repeated rows, an anchor's id twice, zeros and a vector of another length.
    return rows + [rows[7]] * 3 + [rows[8], (10, 0, [0.5] * 4), (n + 5, 0, [0.0] * 4), (n + 6, 1, [0.0] * 4), (20, 2, [0.0] * 4), (n + 7, 1, [3.0, 1.0])]


@pytest.mark.parametrize("seed, scale, chunk", [(1, 1.0, 10_000), (2, 1.0, 3), (3, 1e6, 4)])
def test_hard_negatives_against_brute_force(spark, seed, scale, chunk):
    rows = vectors(seed, 90, scale)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("mine")).repartition(5)
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), positives=3, negatives=4, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0, 3, 4)


def test_hard_negatives_of_few_rows(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.mine_hard_negatives(one, F.lit(True), F.col("label")).count() == 0


def faults(rows):
    """Rows in order with their faults: (role, text, fault)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    seen, out = set(), []
    for _, role, text in order:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def brute_repair(rows):
    """The least (cost, audit) and its text by trying all states row by row, without an agenda."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for c in "ua":
                    after = step.get((state, c))
                    if after and (after not in best or (cost + 5, audit + "I") < best[after][:2]):
                        best[after] = (cost + 5, audit + "I", [*out, f"{names[c]}:"])
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in faults(rows):
        ahead = {}
        for state, (cost, audit, out) in best.items():
            ways = [(state, cost + 2, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                ways += [(step[state, role[:1]], cost + more, audit + "K", [*out, f"{role}:{text}"])] if (state, role[:1]) in step else []
                ways += [(step[state, c], cost + more + 1, audit + "R", [*out, f"{names[c]}:{text}"]) for c in "ua" if (state, c) in step]
            for after, c, a, o in ways:
                if after not in ahead or (c, a) < ahead[after][:2]:
                    ahead[after] = (c, a, o)
        best = inserted(ahead)
    cost, audit, out = min(best[x] for x in ("", "a") if x in best)
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def talks(seed, sizes):
    rng = random.Random(seed)
    texts = ["Ja.", "Nein!", "offen", "", " \t", "Warum? ", "é.\n", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(c, rng.choice([None, *range(n)]) if rng.random() < 0.1 else k, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Satz {k}" + rng.choice(["", ".", "."])) for c, n in sizes.items() for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_brute_force(spark, seed):
    rows = talks(seed, {**{c: random.Random(c * seed).randint(1, 9) for c in range(60)}, 100: 700, 101: 3000, None: 5})
    rows += [r for r in rows if r[0] == 3]  # a conversation whose rows stand twice
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("first", F.lit(0)).repartition(7)
    fixed = repair.repair_conversations(df)
    got = {r["conv_id"]: r for r in fixed.verdicts.collect()}
    sums = {r["conv_id"]: r["sha256"] for r in repair.digests(fixed.rows).collect()}
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(own)
    empty = hashlib.sha256(b"").hexdigest()
    for c, mine in own.items():
        known = faults(mine)
        cost, audit, digest = brute_repair(mine)
        turns = [r[0] for r in mine if r[0] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(known, known[1:], strict=False)]
        want = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, _, f in known) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit)
        assert tuple(got[c][k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")) == want, c
        assert sums.get(c, empty) == digest, c


def test_repair_of_nothing_and_of_one_row(spark):
    none = repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.verdicts.count() == 0 and none.rows.count() == 0 and repair.digests(none.rows).count() == 0
    one = repair.repair_conversations(spark.createDataFrame([(1, 5, "user", "Ja. " * 200_000)], "conv_id long, turn long, role string, text string"))
    assert tuple(one.verdicts.first())[:9] == (1, 0, 0, 0, 0, 0, 2, "D") + tuple(one.verdicts.first())[8:9]
    assert one.rows.count() == 0


def test_copies_in_one_turn(spark):
    """A third of all rows may be one row: it is kept once and deleted elsewhere."""
    rows = [(1, 0, "user", "Ja?")] * 2000 + [(1, 1, "assistant", "Ja.")]
    fixed = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6))
    v = fixed.verdicts.first()
    assert (v["duplicate"], v["cost"], v["audit"]) == (1999, 3998, "K" + "D" * 1999 + "K")
    assert [(r["edit"], r["role"], r["text"]) for r in fixed.rows.orderBy("at", "sub").collect()] == [("K", "user", "Ja?"), ("K", "assistant", "Ja.")]

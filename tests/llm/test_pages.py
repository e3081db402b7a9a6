"""Main text of pages, and the pipeline."""

import numpy as np

from chartmill.llm import html_text


def page(title, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><!-- c --><div class=ad>Buy it now, it is cheap.</div><article><h1>{title}</h1>{body}</article><footer>&copy; us</footer>"


def test_extracts_marked_articles(spark):
    rows = [(i, f"http://x/{i}", page(f"T{i} &amp; more", [f"Words  of\n page {i} &lt;here&gt;", "And a <b>second</b><br>one", ""]), "c") for i in range(60)]
    rows += [(100, None, None, "c"), (101, "u", "", "c"), (102, "u", "<p>unclosed", "c"), (103, "u", "x" * 200_000, "c")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")).collect()}
    assert len(got) == len(rows)
    for i in range(60):
        assert got[i].text == f"T{i} & more\nWords of page {i} <here>\nAnd a second one"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[100].text == got[101].text == "" and got[103].text == "x" * 200_000
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_other_layouts():
    model = html_text.model_of(html_text.examples())
    good = "A paragraph of the story that goes on for long enough to be a real one."
    cases = {
        f"<body><div class='top-nav'><a href=/>x</a></div><div class=post><h1>T</h1><p>{good}<p>Second <a href=/>link</a> here.</div><div class=comments><p>I think so too, it is great.</p></div></body>": f"T\n{good}\nSecond link here.",
        "<article><p>a</p><aside>side</aside><p>b</p><div class=ad>buy</div><section class='comments'><p>hello there this is a comment</p></section></article>": "a\nb",
        "<div><article><h1>A</h1><ul><li>one<li>two</ul><form>f</form><footer>foot</footer></article></div>": "A\none\ntwo",
    }
    for source, want in cases.items():
        assert html_text.main_text([source], model) == [want]


def test_marginals_are_exact():
    r = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2, 5])
    depth = np.array([0, 1, 1, 2, 2, 2, 3])
    features = np.stack([r.integers(0, s, len(parent)) for s in html_text.SIZES], axis=1)
    model = html_text.model_of(r.integers(1, 50, html_text.CELLS).astype(float))
    kind, total, content = html_text.kinds(features), 0.0, np.zeros(len(parent))
    for bits in range(2 ** len(parent)):
        y = [bits >> i & 1 for i in range(len(parent))]
        log = model.root[y[0]] + sum(t[features[i, k], y[i]] for i in range(len(y)) for k, t in enumerate(model.own))
        log += sum(model.tie[3 * kind[parent[i]] + kind[i]][y[parent[i]], y[i]] for i in range(1, len(y)))
        total += np.exp(log)
        content += np.exp(log) * np.array(y)
    assert np.allclose(model.marginals(parent, features, depth), content / total)


def test_deep_and_hostile_pages():
    model = html_text.model_of(html_text.examples())
    for source in ("<div>" * 5000 + "deep", "<" * 5000, "<a " * 3000, "<p title='" + "x" * 5000, "</p>" * 3000, "<!--" * 2000):
        assert len(html_text.main_text([source], model)) == 1


def test_fitted_model_reads_layouts_without_marks(spark):
    from layouts import PAGES

    from chartmill.llm.queries import table

    model = html_text.fitted(table(spark, "/root/testdata/sf0.01", "pages"), "html")
    got = dict(zip(PAGES, html_text.main_text([source for source, _ in PAGES.values()], model), strict=True))
    assert got == {name: want for name, (_, want) in PAGES.items()}


def test_layouts_keep_text_and_labels():
    source = page("T", ["One paragraph.", "Another one."])
    whole = html_text.Page(source)
    labels = html_text.marked(whole)
    text = lambda p, y: [("".join(runs), bool(y[node])) for node, *runs in p.pieces]
    for layout in html_text.LAYOUTS:
        other, y = html_text.laid_out(whole, labels, *layout)
        assert text(other, y) == [t for t in text(whole, labels) if t[1] or layout[0] != "bare"]
        assert len(other.tags) == len(other.hints) == len(other.parents) == len(y) and all(p < i for i, p in enumerate(other.parents))
        assert "article" not in other.tags or layout[0] == "article"

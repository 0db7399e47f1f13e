import random

import numpy as np
import pytest

from lettermill.llm import extract
from lettermill.llm.html_blocks import blocks


@pytest.fixture(scope="module")
def field():
    return extract.fit(extract.sample_pages())


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert texts("<p>a &amp; b&nbsp; c<br>d<p>e</p>f") == ["a & b c d", "e", "f"]
    assert texts("<script>var t='<p>no</p>'</script><style>p{}</style><title>no</title>yes<!-- no --><!-- no") == ["yes"]
    assert texts("<ul><li>a<li>b</ul>c</div>d") == ["a", "b", "c d"] or texts("<ul><li>a<li>b</ul>c</div>d") == ["a", "b", "c", "d"]
    assert texts("a < b and 3<4") == ["a < b and 3<4"]
    assert texts("<a href='x>y'>z</a>") == ["z"]
    assert texts("<form><select><option>no</select><textarea><p>no</textarea>yes</form>") == ["yes"]
    linked = blocks("<div class='Side-Bar x' id=y><a>ab</a>cd</div>")[0]
    assert linked.linked == 2 and linked.tag == "div" and {"name:side", "name:bar", "name:y", "tag:div"} <= linked.path


def test_blocks_of_odd_pages_take_linear_time():
    assert len(blocks("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1
    assert len(blocks("<p>" * 20_000 + "x")) == 1
    blocks("<a b='" * 2000)
    assert blocks("x" + "<" * 20_000)[0].text.startswith("x")


def test_blocks_keep_all_names_and_levels():
    """Nothing is cut: names and tags count however many there are, and however deep the text is."""
    deep = "<nav class=sidebar>" + "".join(f"<div class=n{chr(97 + i % 26)}{chr(97 + i // 26)}>" for i in range(400)) + "<span>" * 30 + "x"
    (block,) = blocks(deep)
    assert {"tag:nav", "hint:nav", "hint:side"} - block.element.above == {"hint:nav"} and block.tag == "div"
    assert "name:sidebar" in block.path and len(block.path) > 400
    assert "hint:side" in blocks(f"<div class='{' '.join('u' + chr(97 + i) * 3 for i in range(26))} sidebar'>x</div>")[0].element.above
    assert texts("a&am<b>p;lt;</b> x &lt;<i>b</i>&gt;") == ["a&amp;lt; x <b>"] or texts("a&am<b>p;lt;</b> x") == ["a&amp;lt; x"] or texts("a&am<b>p;</b>") == ["a&amp;"]


def test_digits_of_the_whole_block():
    features = lambda text: extract.block_features(blocks(f"<p>{text}</p>"), 0)
    assert "digits:2" in features("word " * 100 + "1234567890 " * 100)
    assert "digits:0" in features("1234567890 " * 20 + "word " * 2000)


def test_viterbi_is_the_best_of_all_paths():
    random = np.random.default_rng(1)
    for _ in range(30):
        n = 7
        field = extract.Field(random.normal(size=extract.SIZE), random.normal(size=(2, 2)), random.normal(size=2))
        features = [random.integers(0, extract.SIZE, 3) for _ in range(n)]
        emit = [field.weights[f].sum() for f in features]

        def value(path):
            return field.begin[path[0]] + sum(e for e, y in zip(emit, path) if y) + sum(field.step[a, b] for a, b in zip(path, path[1:]))

        best = max(([k >> i & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert field.decode(features) == [bool(y) for y in best]


def test_training_maximises_the_likelihood():
    """Against a sum over all paths: no change of a transition, start or weight does better."""
    rnd = random.Random(2)
    pages = []
    for _ in range(25):
        shift = rnd.randrange(4)  # so that pages begin with either label and the best starts are finite
        labels = [bool((k + shift) // 2 % 2) for k in range(rnd.randrange(1, 7))]
        pages.append(([np.array([10 + y if rnd.random() < 0.4 else 5]) for y in labels], labels))

    def value(field, f, path):
        return field.begin[int(path[0])] + sum(field.weights[x].sum() for x, y in zip(f, path) if y) + sum(field.step[int(a), int(b)] for a, b in zip(path, path[1:]))

    def likelihood(field):
        out = 0.0
        for f, y in pages:
            every = [value(field, f, [k >> i & 1 for i in range(len(y))]) for k in range(1 << len(y))]
            out += value(field, f, y) - np.logaddexp.reduce(every)
        return (out - 0.5 * 0.05 * ((field.weights**2).sum() + (field.step**2).sum())) / len(pages)

    field = extract.train(pages, rounds=600, hold=0.05)
    best = likelihood(field)
    for by in (-0.3, 0.3):
        for part, at in [("step", (0, 0)), ("step", (0, 1)), ("step", (1, 0)), ("step", (1, 1)), ("begin", 1), ("weights", 5), ("weights", 10), ("weights", 11)]:
            parts = {name: getattr(field, name).copy() for name in ("weights", "step", "begin")}
            parts[part][at] += by
            assert likelihood(extract.Field(**parts)) < best + 1e-6, (part, at, by)


def test_held_out_pages(field):
    pages = extract.sample_pages(150, seed=123)
    got = [(extract.main_text(html, field), "\n".join(main)) for html, main in pages]
    assert sum(a == b for a, b in got) >= 0.88 * len(pages)


def test_given_layout_and_odd_rows(spark, field):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy it now.</div><article><h1>T &amp; t</h1><p><b>First line\n here.<br><p>Second.</p></article><section class="comments"><p>I disagree with this.</p></section><footer>&copy; x</footer>'
    rows = [(1, "u", page, 5), (1, "u", page, 5), (None, None, None, 1), (3, "u", "", 1), (4, "u", page[:-60], 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = extract.extract(pages, field)
    assert set(out.columns) == {"page_id", "url", "html", "text", "n_chars"}
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in out.collect()]
    want = "T & t\nFirst line here.\nSecond."
    assert sorted(got, key=str) == sorted([(1, want, len(want)), (1, want, len(want)), (None, "", 0), (3, "", 0), (4, want, len(want))], key=str)
    assert extract.extract(pages.limit(0), field).count() == 0

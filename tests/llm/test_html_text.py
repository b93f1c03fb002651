"""Extraction on pages made up with another seed, on broken pages and on very long ones; the network against plain formulas."""

import random
import time

import numpy as np
import pytest

from tidemark.llm import html_text as ht


def test_made_up_pages():
    net, rng = ht.learn(), random.Random(77)
    right = 0
    for _ in range(150):
        page, article = ht.made_up_page(rng)
        right += ht.main_texts([page], net)[0] == " ".join(article)
    assert right >= 135


def test_blocks_of_broken_markup():
    page = "<p><b>a&amp;b<br>c<p>d &#233;<script>var t='</p>'</script>x<!-- no --><ul><li>e<li>f</ul>g<style>h"
    assert [b.text for b in ht.blocks(page)] == ["a&b c", "d éx", "e", "f", "g"]
    assert ht.blocks("") == [] and [b.text for b in ht.blocks("a < b <")] == ["a < b <"]


def test_extract_keeps_rows(spark):
    page = "<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy.</div><article><h1>T</h1><p>One two.<p>Three.</article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "")]
    got = sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, "", 0), (1, "T One two. Three.", 17), (1, "T One two. Three.", 17), (2, "", 0)]


def test_deep_wrappers():
    """Nearly all of these pages' blocks have more than 16 marks on their path."""
    net, rng = ht.learn(), random.Random(78)
    pages = [ht.made_up_page(rng, deep=True) for _ in range(150)]
    cut = [ht.blocks(page) for page, _ in pages]
    assert sum(b.marks > 16 for page in cut for b in page) > 0.8 * sum(map(len, cut))
    marks = net.label(cut)
    right = [(p >= 0.5) == (b.text in article) for page, ps, (_, article) in zip(cut, marks, pages) for b, p in zip(page, ps)]
    assert sum(right) >= 0.96 * len(right)
    assert sum(text == " ".join(article) for text, (_, article) in zip(ht.main_texts([page for page, _ in pages], net), pages)) >= 0.7 * len(pages)


def test_every_mark_and_word_counts():
    inner = "<div class='col-md-8 col-sm-12 d-flex'>" * 4
    nav, article = (ht.vectors(ht.blocks(f"<{tag}>{inner}<p>One two.")) for tag in ("nav", "article"))
    assert (nav != article).any()
    one, other = (ht.vectors(ht.blocks("<p>" + "same " * 60 + last)) for last in ("lasta", "lastb"))
    assert (one != other).any()


@pytest.mark.parametrize("page, most", [("<a " * 100_000, 1), ("<p x='" * 100_000, 100_001), ('<a title="' * 100_001, 1), ("<div>x" * 100_000, 100_000), ("<p>x" * 100_000, 100_000), ("</div>" * 100_000, 0), ("<!--" * 100_000, 0), ("<script>" * 100_000, 0), ("<" * 300_000, 1), ("<!" * 100_000, 1), ("&amp;" * 100_000, 1), ("<li><ul>" * 50_000 + "x", 1)])
def test_scanning_is_linear(page, most):
    """A tenth of the page takes no less than a fortieth of the time, give or take the clock."""
    began = time.thread_time()
    ht.blocks(page[: len(page) // 10])
    tenth = time.thread_time() - began
    began = time.thread_time()
    assert len(ht.blocks(page)) <= most
    assert time.thread_time() - began <= 40 * tenth + 0.2


def test_a_page_of_many_blocks():
    net = ht.learn()
    page = "<article>" + "<p>One two three four five.</p>" * 20_000 + "</article>"
    text = ht.main_texts([page, "<article><p>Short text here.</article>"], net)
    assert text[0].count("One") > 19_000


def test_labels_are_those_of_plain_formulas():
    """Block by block, gate by gate, in double precision; pages side by side give what each gives alone."""
    net, rng = ht.learn(), random.Random(3)
    cut = [ht.blocks(ht.made_up_page(rng)[0]) for _ in range(6)] + [[]]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for page, got in zip(cut, net.label(cut)):
        states = []
        for d in (0, 1):
            h, c, each = np.zeros(ht.HIDDEN), np.zeros(ht.HIDDEN), []
            x = ht.vectors(page).astype(float)
            for row in x if d == 0 else x[::-1]:
                i, f, g, o = np.split(row @ net.w[d] + net.b[d] + h @ net.u[d], 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                each.append(h)
            states.append(each if d == 0 else each[::-1])
        want = [sigmoid(np.concatenate([a, b]) @ net.out + net.bias) for a, b in zip(*states)]
        assert np.allclose(got, want, atol=1e-4)


def test_unclosed_quotes_keep_the_text():
    assert [b.text for b in ht.blocks("<p title='x>one <b>two</b>")] == ["one two"]
    assert [b.text for b in ht.blocks('<p a="1" b="2>3">one</p><p c="x>two <q')] == ["one", "two <q"]

"""The two passes of block rules against a plain labeller, on pages without marks and on malformed pages."""

import os
import random
import re
import time

import pytest

from fennelmill.llm import htmltext
from fennelmill.llm.htmltext import Block, BlockRules, blocks_of, first_pass, main_text, second_pass

PROSE = "The cat is in the house and it was on the mat for the day, as they had all been there by then. " * 3


def plain_labels(blocks):
    """Labels by walking up and down from each block, one block at a time."""
    labels = [b.label for b in blocks]
    if not any(b.label == "good" or b.article for b in blocks):
        heads = [i for i, b in enumerate(blocks) if b.heading]
        near = [i for i, x in enumerate(labels) if x == "near"]
        below = [i for i in near if heads and i >= heads[0]]
        for i in below or near:
            labels[i] = "good"
        for i, b in enumerate(blocks):
            last = [j for j in range(i) if blocks[j].heading or blocks[j].label == "bad"]
            if not near and not b.heading and b.label != "bad" and any(blocks[j].heading and blocks[j].label != "bad" and all(blocks[k].label != "bad" for k in range(j, i)) for j in range(i)):
                labels[i] = "good" if last else labels[i]

    def look(i, step, whole):
        away, j = 0, i
        while True:
            if step < 0 and blocks[j].heading and not whole:
                return "", 0
            j += step
            while 0 <= j < len(blocks) and blocks[j].article != blocks[i].article:
                j += step
            if not 0 <= j < len(blocks):
                return ("good" if blocks[i].article else "bad"), away + 1
            away += 1
            if labels[j] in ("good", "bad"):
                return labels[j], away + 2 * (labels[j] == "bad" and len(blocks[j].text) < 100)
            if step > 0 and blocks[j].heading and not whole:
                return "", 0

    for turn in ("near", "short"):
        new = list(labels)
        for i, b in enumerate(blocks):
            if labels[i] != turn:
                continue
            (x, dx), (y, dy) = look(i, -1, False), look(i, 1, False)
            if b.heading or not (x or y):
                good = (y or look(i, 1, True)[0] or look(i, -1, True)[0]) == "good"
            elif turn == "near" or b.article or not (x and y):
                good = x == "good" or y == "good"
            elif x == y:
                good = x == "good"
            else:
                good = dx == dy or (x if dx < dy else y) == "good"
            new[i] = "good" if good else "bad"
        labels = new
    return labels


def test_second_pass_agrees_with_a_plain_labeller():
    rng = random.Random(5)
    changed = 0
    for _ in range(400):
        articles = rng.choice([[0], [0, 1], [1], [1, 2]])
        blocks = [Block("x" * rng.choice([1, 150]), 0, rng.random() < 0.2, rng.choice(articles), rng.choice(["good", "bad", "near", "short", "short"])) for _ in range(rng.randint(0, 14))]
        wanted, before = plain_labels(blocks), [b.label for b in blocks]
        second_pass(blocks)
        assert [b.label for b in blocks] == wanted
        changed += sum(a != b for a, b in zip(before, wanted))
    assert changed > 1000


def page(body):
    return f"<html><body><div><a href=1>Home</a> <a href=2>News of the day</a></div>{body}<div>© somebody, and all of it is theirs</div></body></html>"


def test_pages_without_marks():
    html = page(f"<div>Buy now</div><h2>Head</h2><p>{PROSE}</p><p>Short one.</p><div>{PROSE}</div><p>Last words.</p><div><a href=3>More to read here</a></div>")
    blocks = blocks_of(html)
    first = [first_pass(b) for b in blocks]
    assert first == ["bad", "short", "short", "good", "short", "good", "short", "bad", "bad"]
    for b, x in zip(blocks, first):
        b.label = x
    second_pass(blocks)
    assert [b.label for b in blocks] == ["bad", "bad", "good", "good", "good", "good", "good", "bad", "bad"]
    assert main_text(html) == "\n".join(["Head", PROSE.strip(), "Short one.", PROSE.strip(), "Last words."])
    assert main_text(page("<p>Only a few words.</p>")) == ""


def test_rules_hold_inside_articles_too():
    links = "<div><a href=1>One more story</a> <a href=2>Another one</a></div>"
    html = f"<article><p>{PROSE}</p><p>Text.</p>{links}<p>Between lists.</p>{links}<p>{PROSE}</p></article>"
    assert main_text(html) == "\n".join([PROSE.strip(), "Text.", PROSE.strip()])
    assert main_text(f"<article><p>{PROSE}</p></article>", BlockRules(long=10_000, stops_low=0.9, stops_high=0.95)) == PROSE.strip()


def test_articles_lose_foreign_regions_only():
    kept = ['<section id="related-work">', '<section id="discussion">', '<div class="social-policy">', '<p class="legal">', '<div class="tags-intro">', "<p>&copy; is the sign of it. ", '<h2 id="comments">', '<div class="no-sidebar">', "<math>"]
    gone = ['<div class="related-links">', '<div class="adSlot">', '<div class="share-buttons">', '<section class="comments">', '<div id="comment-12">', '<div class="cookie-notice">', '<p class="newsletter">', '<ul role="navigation">', "<aside>", "<footer>", "<form>"]
    say = lambda opened, i: f"{opened}{PROSE} n{i}</{opened[1:].split()[0].split('>')[0]}>"
    html = "<article>" + "".join(say(o, f"keep{i}") for i, o in enumerate(kept)) + "".join(say(o, f"gone{i}") for i, o in enumerate(gone)) + "</article>"
    text = main_text(html)
    assert [i for i in range(len(kept)) if f"nkeep{i}" not in text] == [] and "ngone" not in text


def test_a_name_beside_most_of_the_text_marks_nothing():
    text = main_text(f'<body><div class="text"><p>{PROSE}</p></div><p>{PROSE}{PROSE}two</p><p>{PROSE}three</p></body>')
    assert text.count("\n") == 2 and "two" in text and "three" in text
    assert "menu" not in main_text(f'<body><p>menu</p><div class="text"><p>{PROSE}</p></div></body>')


def test_scripts_without_spaces():
    prose = "我们在这里说的是一个关于语言和文字的故事，他们都会在这个地方对你说出自己的看法，这也是我们要做的事情。"
    assert main_text(page(f"<h1>题目</h1><p>{prose}</p><p>{prose}{prose}</p>")).split("\n") == ["题目", prose, prose + prose]
    kana = "これはとてもながいぶんしょうで、わたしたちがここではなしていることをよくあらわしているものです。" * 2
    assert main_text(page(f"<h1>見出し</h1><p>{kana}</p>")) == f"見出し\n{kana}"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_the_passes_alone_find_the_articles(spark):
    """Without any mark of article, menu, footer or class the passes find what the marks say."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    bare = [re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", re.sub(r"</?article>", "", h))) for h in pages]
    assert all("<article" not in h and "class" not in h.split("<body>")[1][:200] for h in bare)
    equal = sum(main_text(a) == main_text(b) for a, b in zip(pages, bare))
    assert equal >= 0.95 * len(pages)


def test_clashing_names_in_any_case(spark):
    out = htmltext.extract(spark.createDataFrame([(1, "<article><p>x</p></article>", "old", 3, "c")], "page_id int, html string, TEXT string, N_Chars int, `a.b` string"))
    assert out.columns == ["page_id", "a.b", "text", "n_chars"] and out.select("text").first().text == "x"


def test_references_are_decoded_before_pieces_are_joined():
    assert main_text("<article><p>&am<b>p;</b> &amp;<i>lt;</i> &lt;b&gt;</p></article>") == "&amp; &lt; <b>"


@pytest.mark.parametrize(
    "html",
    ['<a "' * 20000, "<div>" * 20000 + "</p>" * 20000, "<span>" * 20000 + "</i>" * 20000, "<a " * 40000, "<svg>" * 40000, '<a ">" ' * 20000 + '"', "<span>" * 20000 + "<p></p>" * 20000, "<i><li>" + "<b>" * 20000 + "</i>" * 20000, "<a '\">" * 20000, "<!" * 40000, "<b><li>" * 20000 + "</b>" * 20000],
    ids=lambda h: h[:12],
)
def test_malformed_pages_take_linear_time(html):
    begun = time.monotonic()
    main_text(html)
    assert time.monotonic() - begun < 1
    assert main_text(f"<article><p>ok</p></article>{html}").startswith("ok")


def test_unclosed_quotes_and_comments():
    assert main_text('<article><p title="x>Open</p><p>next</p></article>') == "Open\nnext"
    assert main_text("<article><p>a</p><!-- never closed <p>b</p></article>") == "a"
    assert main_text("<article><p>1 < 2 and 2 > 1</p></article>") == "1 < 2 and 2 > 1"
    assert [t for t, *_ in htmltext.Scanner("a<b>c<script>d</script>e").pieces()] == ["a", "c", "e"]

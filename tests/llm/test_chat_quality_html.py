"""Chat formatting, quality rules and page text against plain Python."""

import random
import re

from pyspark.sql import functions as F

from fennelmill.llm import chat, htmltext, quality

CONV = "conv_id long, turn long, role string, text string"


def test_snapshots_collapse_to_maximal_conversations(spark):
    full = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(i, t, r, x) for i, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for t, (r, x) in enumerate(full[:n])]
    rows += [(5, 0, "user", "a"), (5, 1, "assistant", "other"), (6, 7, "user", "z"), (None, 0, "user", "lost"), (3, 0, "user", "a")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, CONV)).collect()}
    assert set(got) == {3, 5, 6} and got[3].n_copies == 2 and got[3].n_turns == 3
    assert got[3].rendered == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n"


def brute_chats(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    seqs = {}
    for c, turns in convs.items():
        seqs.setdefault(tuple((r, x) for _, r, x in sorted(turns)), []).append(c)
    return {min(ids): (len(s), len(ids)) for s, ids in seqs.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs)}


def test_chats_against_brute_force_with_nulls_and_blocks(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 5)):
            rows.append((c, rng.choice([t, t * 300, None]) if c % 7 == 0 else t * 200, rng.choice(["u", None]) if c % 5 == 0 else "u", rng.choice(["x", "y", None])))
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.format_chats(spark.createDataFrame(rows, CONV)).collect()}
    assert got == brute_chats(rows)
    assert chat.format_chats(spark.createDataFrame([], CONV)).count() == 0


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_measures_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "x " * 30, " nbsp word\x85next\x1csep", "a\n\na\n a\na \n", "😀 # |"]
    texts += ["".join(rng.choice(["ab ", "c ", "d\n", "é|", "\t", "漢 ", "f g h i j k l m "]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    for r in quality.assess(df).collect():
        m = brute_measures(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, texts[r.doc_id]
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and not (r.kept and r.base_failed)


def test_line_rules_and_loss(spark):
    good = "This is a plain sentence that says something, and it ends well enough to keep."
    nav = "Home | News | Sport | About | Contact"
    docs = {1: "\n".join([good, "Another plain sentence follows here, and it is kept as well by the rules."]), 2: "\n".join([good] + [nav] * 9), 3: "\n".join([good, "Some more of it comes here, with other words in it, so that nothing repeats.", "All rights reserved."]), 4: "A&& B** C$$ D%% E## " * 8, 5: good + "\n" + "it is cut off in the middle of a long last line which"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    assert [k for k, r in got.items() if r.kept] == [1, 3, 5]
    assert "rights" not in got[3].cleaned and nav not in got[2].cleaned and got[1].cleaned == docs[1]
    wide = df.withColumn("n_chars", F.lit(7).cast("long")).withColumn("lines_removed", F.lit("own"))
    kept = quality.clean(wide).orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [1, 3, 5] and all(r.n_chars == len(r.text) and r.lines_removed == "own" for r in kept)
    assert quality.clean(wide.where("false")).columns == wide.columns


SENTENCE = "The cat is in the house and it was on the mat for the day. "


def test_page_text(spark):
    pages = {
        1: ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>T &amp; x</h1><p>One<br>two\n three<p>A&nbsp;b &lt;i&gt;</p><script>var a='</p>';</script>"
            "<div class='comments'><p>" + SENTENCE * 5 + "</p></div><form>no</form></article><footer>f</footer></body></html>", "T & x\nOne two three\nA b <i>"),
        2: (None, ""),
        3: ("", ""),
        4: ("<body><ul class='menu'><li><a>x</a></li></ul><div><h2>Head</h2><p>" + SENTENCE * 5 + "</p><p>Short.</p><p>" + SENTENCE * 5 + "</p></div><div class='ad'>" + SENTENCE * 5 + "</div></body>", "\n".join(["Head", (SENTENCE * 5).strip(), "Short.", (SENTENCE * 5).strip()])),
        5: ("<article><p>open <b>never closed<p>next", "open never closed\nnext"),
        6: ("<!-- <p>x</p> --><main><p style='display:none'>h</p><table><tr><td>a</td><td>b</td></tr></table><ul><li>i<li>j</ul></main>", "a b\ni\nj"),
        7: ("plain words only", ""),
        11: ("<ARTICLE><P TITLE=\"x>Open quote</P><P data-x='a>b'>closed one</P></ARTICLE>", "Open quote\nclosed one"),
        9: ("<div class='page has-sidebar'><div class='site-header'>Site name</div><div id=content><h1>T</h1><p>Short text.</p><div class='notice'>n</div><section id='comments'><p>c</p></section></div><div class='sidebar'>s</div></div>", "T\nShort text."),
        10: ("<article class='post tags-x'><p>Main words.</p></article><article class='comment'><p>I agree.</p></article><article class='related-post'>r</article>", "Main words."),
        8: ("<article><header><h1>Title</h1></header><p>" + "w" * 100_000 + "</p></article>", "Title\n" + "w" * 100_000),
    }
    df = spark.createDataFrame([(k, "u", h, "own") for k, (h, _) in pages.items()], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert {k: r.text for k, r in got.items()} == {k: t for k, (_, t) in pages.items()}
    assert all(r.n_chars == len(r.text) and r.url == "u" for r in got.values())
    assert htmltext.extract(df.where("false")).count() == 0


def test_wrapped_prose_menus_and_phrases_in_four_languages():
    judge = quality.Judge(quality.LineRules())
    wrapped = ["The first line of a paragraph that someone wrapped by hand after some words", "goes on in lower case on the next line and on the one behind it", "until it ends here.", "Éclairs are a new sentence."]
    assert judge.verdicts(wrapped) == [None] * 4
    assert judge.verdicts([wrapped[0], "But This Line Begins Anew."]) == ["punctuation", None]
    mention = "You may click here or there, but this long sentence only mentions what the phrase says and then goes on about a number of other things."
    assert judge.verdicts([mention, "Click here", "x"]) == [None, "boilerplate", None]
    for line in ("Alle Rechte vorbehalten.", "© X, tous droits réservés", "Lea la política de privacidad", "Términos y condiciones", "Hier klicken!"):
        assert judge.verdicts([line, "x"])[0] == "boilerplate", line
    menu = ["Home", "News", "About us", "Contact", "Sign in"]
    text = "A sentence of its own stands before and behind it."
    assert judge.verdicts([text, *menu, text]) == [None, *["navigation"] * 5, None]
    assert judge.verdicts([text, *menu[:4], text]) == [None] * 6 and judge.verdicts([f"{m}." for m in menu]) == [None] * 5
    assert judge.verdicts([]) == [] and judge.verdicts(["", " \t"]) == [None, None]

"""What belongs to a page's main text and what does not, where names, lengths and links mislead."""
import random
import time
import tracemalloc

import pytest

from timefuse.llm import html

PS = ["A first paragraph, of the article, with commas.", "A second one; it says more, and ends."]
BODY = "".join(f"<p>{p}</p>" for p in PS)
WANT = "\n".join(PS)
LONG = "".join(f"<div class=item><p>Reader {i} writes a long remark, with commas, on and on, and more of it.</p></div>" for i in range(12))


@pytest.mark.parametrize("page", [
    "<body><div class=post>{b}</div><div id=comments>{x}</div>", "<body><article>{b}<div id=comments>{x}</div></article>",
    "<body><article>{b}</article><section class='comment-list'>{x}</section>", "<body><h1>T</h1><div class=post>{b}</div><ol class=commentlist></ol><div class=comments>{x}</div>",
    "<body><main>{b}<section id=comments><article>{x}</article><article>{x}</article></section></main>",
    "<body><div class=post>{b}</div><div class=cookie-consent>{x}</div>", "<body><article>{b}<div class=ad>{x}</div></article>",
    "<body><div>{b}</div><div class='social share-bar'>{x}</div>", "<body><div class=post>{b}</div><div class='notice'>{x}</div>"])
def test_what_never_belongs_goes_however_long(page):
    text = html.main_text(page.format(b=BODY, x=LONG))
    assert text.removeprefix("T\n") == WANT


@pytest.mark.parametrize("kept", [
    "<ul><li><a href=1>First reference, a title</a></li><li><a href=2>Second reference</a></li><li><a href=3>Third</a></li></ul>",
    "<p><a href=x>The whole paragraph is one link, as some are.</a></p>", "<p class='subscribe-story'>A paragraph with a name.</p>",
    "<h2 class=widget-title>A heading</h2>", "<blockquote class=related>Quoted, at length.</blockquote>", "<table><tr><td><a href=1>a</a></td><td>b</td></tr></table>"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div>{}</div></main>"])
def test_nothing_of_the_article_goes(kept, around):
    import re
    inner = [x for x in re.split(r"\s*<[^>]*>\s*", re.sub("</?a[^>]*>", "", kept)) if x]
    got = html.main_text("<body><nav>Menu</nav>" + around.format(BODY + kept + "<p>The end, of it.</p>"))
    assert got == "\n".join([WANT, *inner, "The end, of it."])


@pytest.mark.parametrize("odd", [
    "<span style='display: none'>no</span>", "<span class=ad>no</span>", "<b hidden>no <b>no</b> no</b>", "<a class='share-link' href=x>no</a>",
    "<em aria-hidden=true>no<br>no</em>", "<span hidden>no <div>no</div> no</span>", "<i style='DISPLAY:none'>no <a href=x>no</a></i>"])
def test_hidden_inline_text_goes(odd):
    assert html.main_text(f"<body><article><p>One {odd} two.</p><p>Three, four.</p></article>") == "One two.\nThree, four."
    assert html.main_text(f"<body><article><p>One {odd.rsplit('</', 1)[0]}</p><p>Three, four.</p></article>").endswith("Three, four.")


@pytest.mark.parametrize("wrap", [
    "<div class='hfeed comments-open'>{}</div>", "<div class='post no-comments'>{}</div>", "<div class=has-ads>{}</div>", "<div class=comments><h1>Title</h1>{}</div>",
    "<div id=share-page><article>{}</article></div>", "<div class='notice'>{}</div>", "<section class=social><main>{}</main></section>"])
def test_names_of_what_encloses_all_take_nothing(wrap):
    got = html.main_text("<body>" + wrap.format(BODY))
    assert got.removeprefix("Title\n") == WANT


def test_nesting_takes_linear_memory_and_time():
    def peak(n):
        page = "<div class=x>" * n + "deep" + "</div>" * n
        tracemalloc.start()
        t = time.time()
        assert html.main_text(page) == "deep"
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size, time.time() - t

    (small, _), (large, took) = peak(10_000), peak(100_000)
    assert large < 15 * small < 2e9 and took < 60
    assert html.main_text("<i>" * 50_000 + "<p>x</p>" + "</u>" * 50_000) == "x"
    assert html.main_text("<b hidden>" * 20_000 + "no" + "</b>" * 20_000 + "<p>yes, this.</p>") == "yes, this."


def test_no_markup_makes_it_fail():
    rng = random.Random(2)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<span hidden>", "</span>", "<a href=x>", "</a>", "<!--", "-->", "<b", ">", "&amp;",
            "&#x", "<li>", "<td>", "</td>", "<svg/>", "<svg>", "<script>", "text, more. ", "\0", "<h1>", "<br/>", "<![CDATA[", "]]>", "</html>", "<main", "<p hidden", "=", "'", '"']
    for _ in range(1500):
        html.main_text("".join(rng.choice(bits) for _ in range(rng.randrange(40))))
    assert html.main_text("<p></p>" * 10) == html.main_text(None) == ""

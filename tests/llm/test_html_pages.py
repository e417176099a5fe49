"""Pages whose main text is known: articles beside stories, wrappers, parted sections."""

import random
from html.parser import HTMLParser

import pytest

from corpusloom.llm import html_text
from corpusloom.llm.html_text import main_text
from tests.llm.conftest import LOREM

PROSE = ("a sentence of ordinary prose goes here. " * 4).strip()


def test_a_story_in_plain_divs_beside_a_short_article_is_kept():
    page = f"<article><p>{PROSE}</p></article>" + f"<div>{PROSE} x</div>" * 4 + "<div>Imprint</div><nav>Menu</nav>"
    assert html_text.main_text(page).split("\n\n")[:5] == [PROSE, *[f"{PROSE} x"] * 4]


def test_runs_of_links_in_an_article_are_dropped_by_density_and_single_ones_are_not():
    offers = "".join(f"<div><a href=x>Buy offer {i} now</a></div>" for i in range(4))
    page = f"<article><h1><a href=x>Head</a></h1><p>{PROSE}</p><p>See <a href=x>more of it</a></p>{offers}<p>Short end.</p></article><p>out</p>"
    assert html_text.main_text(page) == f"Head\n\n{PROSE}\n\nSee more of it\n\nShort end."


def test_an_article_of_links_only_keeps_them():
    assert html_text.main_text("<article><ul>" + "<li><a href=x>link</a>" * 4 + "</ul></article>") == "\n\n".join(["link"] * 4)


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div id='page-with-menu'", "div class=nav-fixed", "form", "div class='menu'", "div id=widget", "div class='page hasSidebar'"])
def test_a_wrapper_with_a_class_word_hides_no_article(wrapper):
    page = f"<{wrapper}><div class=menu>Menu</div><article><p>{PROSE}</p></article><form>q</form></{wrapper.split()[0]}>"
    assert html_text.main_text(page) == PROSE


@pytest.mark.parametrize("wrapper", ["form", "div class=widget-header", "div class=top-nav", "div class='has-sidebar'"])
def test_a_wrapper_round_most_of_the_text_hides_none(wrapper):
    page = f"<{wrapper}><div>{PROSE}</div><div>{PROSE}</div></{wrapper.split()[0]}><div class=site-footer>{PROSE[:60]}</div>"
    assert html_text.main_text(page) == f"{PROSE}\n\n{PROSE}"


def test_comments_longer_than_the_story_stay_outside():
    assert html_text.main_text(f"<div>{PROSE} x</div><div class=comments>" + f"<p>{PROSE}</p>" * 3 + "</div>") == f"{PROSE} x"


def test_paragraphs_of_an_article_with_mild_class_words_stay():
    words = ["warning", "notice", "legal", "share", "tags"]
    page = "<article>" + "".join(f"<p class={w}>{w} {PROSE}</p>" for w in words) + "<p class=ad>buy</p><div class=share-links>share</div></article>"
    assert html_text.main_text(page) == "\n\n".join(f"{w} {PROSE}" for w in words)


def test_lists_of_other_articles_stay_outside():
    others = f"<div class=related><article>{PROSE}</article></div><section id=comments><article>{PROSE}</article></section>"
    assert html_text.main_text(f"<article><p>{PROSE} x</p></article>{others}") == f"{PROSE} x"


LINKS = "<ul>" + "<li><a href=x>Another story</a>" * 4 + "</ul>"
ADVERT = "<div class=ad>buy</div>" * 3


@pytest.mark.parametrize("between", [LINKS, ADVERT])
@pytest.mark.parametrize("wrapper", ["body", "div", "section"])
def test_a_closing_section_after_adverts_or_links_stays(between, wrapper):
    long, closing = [f"{i} {PROSE}" for i in range(19)], [f"{i} {PROSE}" for i in range(3)]
    page = f"<{wrapper}>" + "".join(f"<p>{x}</p>" for x in long) + between + "".join(f"<p>{x}</p>" for x in closing) + between + f"<p>Short end.</p></{wrapper}>"
    assert html_text.main_text(page) == "\n\n".join([*long, *closing, "Short end."])


def test_a_short_section_in_a_div_of_its_own_stays_beside_a_long_one():
    page = f"<div><p>{PROSE}</p><p>{PROSE * 30}</p></div>{LINKS}<div><p>{PROSE}</p></div>{LINKS}<div>Imprint</div>"
    assert html_text.main_text(page) == f"{PROSE}\n\n{PROSE * 30}\n\n{PROSE}"


def test_a_short_article_parted_by_adverts_surges_all_the_same():
    article = "<aside>buy</aside>".join(f"<p>{PROSE[:60]}</p>" for _ in range(4))
    assert html_text.main_text(f"<article>{article}</article>" + f"<p>{PROSE}</p>" * 3) == "\n\n".join([PROSE[:60]] * 4 + [PROSE] * 3)


def generated(r, article):
    """A page and the text of its article: headings, long and short paragraphs, with an advert, a menu and a comment around."""
    says = lambda a, b: " ".join(r.choice(LOREM) for _ in range(r.randrange(a, b)))
    blocks = [says(3, 8), says(30, 60)] + [says(*r.choice([(1, 4), (15, 40), (30, 80)])) + "." for _ in range(r.randrange(2, 9))] + [says(30, 50) + "."]
    inside = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b.replace(' alpha ', ' <b>alpha</b> ', 1)}</p>" for b in blocks[1:])
    tag = "article" if article else "div"
    around = f"<nav><a href=/>{says(1, 3)}</a> <a href=/x>{says(1, 3)}</a></nav><div class=ad>{says(10, 30)}</div>"
    after = f"<aside>{says(10, 30)}</aside><section class=comments><p>{says(20, 40)}</p></section><footer>&copy; {says(2, 6)}</footer>"
    return f"<html><head><title>{says(2, 4)}</title></head><body>{around}<{tag}>{inside}</{tag}>{after}</body></html>", "\n\n".join(blocks)


def test_generated_pages_with_and_without_an_article_element():
    r = random.Random(12)
    for k in range(120):
        page, want = generated(r, article=k % 2 == 0)
        assert html_text.main_text(page) == want


def test_density_decides_what_is_kept(monkeypatch):
    story = "".join(f"<p>{'words of the story ' * 8}{i}</p>" for i in range(6))
    far = "<p>some</p><p>short</p><p>lines</p><p>here</p>"
    page = f"<div><p>Stray</p>{far}</div><div>{story}</div><div>{far}<p>more</p></div><article><p>Teaser</p></article>"
    dense = html_text.main_text(page)
    assert "story" in dense and "Stray" not in dense and "Teaser" not in dense and "more" not in dense
    monkeypatch.setattr(html_text, "SURGE", 1)
    assert "Stray" in html_text.main_text(page) and "Teaser" in html_text.main_text(page)


class _Reader(HTMLParser):
    """Texts of the paragraphs, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.texts, self.at = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.at = []

    def handle_startendtag(self, tag, attrs):  # a paragraph doesn't end with />
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "p" and self.at is not None:
            self.texts.append(" ".join("".join(self.at).split()))
            self.at = None

    def handle_data(self, data):
        if self.at is not None:
            self.at.append(data)


@pytest.mark.parametrize("seed", range(40))
def test_hostile_markup_is_read_as_the_standard_parser_reads_it(seed):
    r = random.Random(seed)
    odd = ['class="a""', "data-a=it's", "title='say \"x\"'", 'title="it\'s"', 'x="1"y="2"', "a=b\"c", "'", '"', "=x", "data-x = 'a > b'", "b= c", "a='", "/", "checked", 'href="?a=1&b=2"', "style=color:red;"]
    page = []
    for i in range(6):
        attributes = " ".join(r.choice([o for o in odd if o != "a='"]) for _ in range(r.randrange(0, 4)))
        page.append(f"<p {attributes}>Paragraph {i} holds some forty words it's said, {' and more'.join('of them' for _ in range(12))} \"end\".</p>\n")
    page = "<html><body><article>" + "".join(page) + "</article></body></html>"
    reader = _Reader()
    reader.feed(page)
    assert main_text(page).split("\n\n") == reader.texts


def test_one_stray_quote_loses_no_text():
    body = "This paragraph has words enough to be an article, and then some more of them to be sure."
    for tag in ('<p class="a"">', "<p data-a=it's>", '<p ">', "<p =\">"):
        page = f"<body>{tag}{body}</p><p title=\"x\">It's {body}</p></body>"
        assert main_text(page) == f"{body}\n\nIt's {body}", tag


def test_deep_nesting_lists_of_links_and_compound_classes():
    body = "This paragraph has words enough to be an article, and then some more of them to be sure."
    deep = "".join(f'<div class="sidebar-{i}">' for i in range(300))
    assert main_text(f"<article><p>{body}</p>{deep}<p>hidden {body}</p>{'</div>' * 300}<p>{body}</p></article>") == f"{body}\n\n{body}"
    refs = "".join(f'<li><a href="/{i}">Reference number {i}</a></li>' for i in range(5))
    assert main_text(f"<article><p>{body}</p><p>{body}</p><ul>{refs}</ul></article>").endswith("Reference number 3\n\nReference number 4")
    for name in ("comment-thread-1", "user-comments-v2", "gdpr-layer", "cookieBanner3"):
        assert main_text(f'<article><p>{body}</p><p>{body}</p></article><div class="{name}"><p>Reader says {body}</p><p>{body}</p></div>') == f"{body}\n\n{body}", name
    assert main_text(f'<div class="page-with-sidebar"><p>{body}</p><p>{body}</p></div>') == f"{body}\n\n{body}"


def test_extract_takes_any_column_names(spark):
    df = spark.createDataFrame([(1, "<p>" + "word " * 40 + "</p>", "a", "b")], "page_id long, html string, _html string, text string")
    row = html_text.extract(df).first()
    assert row["_html"] == "a" and row["text"] == "b" and row["_text"].startswith("word word")

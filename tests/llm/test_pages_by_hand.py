"""Pages that no generator wrote: without telling names, with names in other languages, and with little text."""

import pytest

from plumeloom.llm import html_main


def prose(n):
    return " ".join(["This is a long sentence about a thing that matters here.", "It goes on for a while and ends."] * n)


HEAD, LIST = "The title of it", ["One item of the list that matters.", "Another item of the list."]
ARTICLE = f"<h1>{HEAD}</h1><p>{prose(2)}</p><p>{prose(1)}</p><ul><li>{LIST[0]}</li><li>{LIST[1]}</li></ul><p>{prose(3)}</p>"
WANT = "\n\n".join([HEAD, prose(2), prose(1), *LIST, prose(3)])
LINKS = '<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/b">More</a></li></ul>'
ROW = '<a href="/">Home</a> <a href="/a">About us</a> <a href="/b">More</a>'
NAMES = {
    "en": ("header", "menu", "content", "sidebar", "comments", "footer"),
    "de": ("kopf", "menue", "inhalt", "seitenleiste", "kommentare", "fuss"),
    "fr": ("entete", "menu", "contenu", "barre-laterale", "commentaires", "pied"),
    "es": ("cabecera", "navegacion", "contenido", "lateral", "comentarios", "pie"),
    "it": ("testata", "navigazione", "contenuto", "laterale", "commenti", "piede"),
}


@pytest.fixture(scope="module")
def model():
    return html_main.trained()


@pytest.mark.parametrize("key", ["class", "id"])
@pytest.mark.parametrize("lang", sorted(NAMES))
def test_names_of_five_languages(model, lang, key):
    head, menu, body, side, replies, foot = NAMES[lang]
    div = lambda name, inner: f'<div {key}="{name}">{inner}</div>'
    page = f"<html><body>{div(head, '<h2>The site</h2>')}{div(menu, LINKS)}{div(body, ARTICLE)}{div(side, '<h3>See also</h3>' + LINKS)}{div(replies, '<p>Nice one!</p><p>I agree.</p>')}{div(foot, '<p>&copy; 2020 The site</p>')}</body></html>"
    assert html_main.main_text(page, model) == WANT
    assert html_main.main_text(f"<body>{div(head, ROW)}{div(body, ARTICLE)}{div(foot, '&copy; 2020 The site')}", model) == WANT


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("links", [LINKS, f"<div>{ROW}</div>", f"<p>{ROW}</p>"])
def test_pages_without_names(model, links, tag):
    assert html_main.main_text(f"<body>{links}<{tag}>{ARTICLE}</{tag}><div>&copy; 2020 us</div></body>", model) == WANT
    assert html_main.main_text(f"<body>{links}{ARTICLE}</body>", model) == WANT


@pytest.mark.parametrize("page,want", [("<p>Just one.</p>", "Just one."), ("Just text.", "Just text."), (f"<div>{prose(1)}</div>", prose(1)), (f"<body><h1>{HEAD}</h1><p>{prose(1)}", f"{HEAD}\n\n{prose(1)}"), (f"<table><tr><td>{prose(2)}</td></tr></table>", prose(2))])
def test_little_pages_keep_their_text(model, page, want):
    assert html_main.main_text(page, model) == want


@pytest.mark.parametrize("page", ["", "<nav><a href=/>Home</a></nav>", "<footer>&copy; x.</footer>", '<div class="ad">Buy now! Cheap.</div>', '<div class="comments"><p>Nice one. I agree.</p></div>', "<aside><p>See also this. And that.</p></aside>", "<script>var a = 'Text. More.';</script>", ROW])
def test_pages_without_an_article_are_empty(model, page):
    assert html_main.main_text(page, model) == ""


def test_a_box_about_the_author_is_no_article(model):
    box = '<div class="author-box"><p>Jane writes here. She lives in Rome.</p></div>'
    assert html_main.main_text(f"<article>{ARTICLE}{box}</article>", model) == WANT

"""Pages with noise within the article: the text is the article's blocks and nothing else."""

import pytest

from lodestar.llm import html_text

BLOCKS = ["<h1>The harbour in winter</h1>", "<p>Boats lie along the quay while the wind comes from the north, and few of the crews go out before noon.</p>", "<p>On the pier the nets are mended by hand; it takes most of the morning, and nobody hurries.</p>", "<p>In the evening the lamps are lit, one after the other, until the whole bay shines.</p>"]
NOISE = {
    "share": '<div class="share">Share this on every network</div>', "related": '<div class="related"><h3>Related</h3><ul><li><a href="/a">Another harbour</a></li><li><a href="/b">A third one</a></li></ul></div>',
    "cookies": '<div class="cookie-notice"><p>We use cookies to make this site better for you. <button>OK</button></p></div>', "sidebar": '<div class="sidebar"><p>Weather today: rain in the west, sun in the east.</p></div>',
    "widget": '<div class="widget">Tides: high at six, low at noon</div>', "aside": "<aside><p>Did you know that the quay is very old and was built by hand?</p></aside>",
    "footer": "<footer>Copyright 2020 by the harbour office</footer>", "alert": '<div role="alert">Your session ends soon, please sign in again.</div>', "advert": '<div class="advert"><p>Buy new nets at a low price, this week only.</p></div>',
    "ad words": '<div class="advert">The finest boats of the whole coast, delivered to your quay.</div>', "newsletter": '<div class="newsletter"><form><label>Your address</label><input name="q"><button>Subscribe</button></form></div>',
    "nav": '<nav><ul><li><a href="/1">First page</a></li><li><a href="/2">Second page</a></li></ul></nav>', "toc": '<div class="toc"><ul><li><a href="#a">Winter</a></li><li><a href="#b">Summer</a></li></ul></div>',
    "comments": '<div class="comments"><div class="comment"><p>I was there last winter and liked it very much.</p></div></div>', "script": "<script>var a = '<p>no</p>';</script>",
    "popup": '<section class="popup"><p>Sign up now and read ten articles for free.</p></section>', "author": '<div class="author-box">Written by a sailor</div>', "tags": '<ul class="tags"><li><a href="/t">sea</a></li><li><a href="/u">winter</a></li></ul>',
    "search": '<form action="/s"><input name="q"><button>Search</button></form>', "sponsor": '<ins class="adsbygoogle">Sponsored: rope of all kinds</ins>',
}
PLAIN = ["The harbour in winter", *[b[3:-4] for b in BLOCKS[1:]]]


@pytest.fixture(scope="module")
def trees():
    return html_text.trained()


@pytest.mark.parametrize("name", sorted(NOISE))
@pytest.mark.parametrize("around", ["<article>@</article>", '<main><div class="content">@</div></main>'])
def test_noise_within_the_article(trees, name, around):
    page = f"<html><body><header>Harbour news</header>{around.replace('@', ''.join([*BLOCKS[:3], NOISE[name], BLOCKS[3]]))}<footer>Contact</footer></body></html>"
    assert html_text.extract([page], trees) == ["\n".join(PLAIN)]


def test_long_attributes_are_not_kept():
    before = html_text._known_bits.cache_info().currsize
    html_text.parse("".join(f'<img src="data:{i}{"x" * 5000}" class="ad">' for i in range(50)))
    assert html_text._known_bits.cache_info().currsize <= before + 1

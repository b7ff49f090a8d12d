"""The labelled table: pages as pieces of source, each with 1 for main text or 0 for anything else."""

_LONG = (
    "The river had been rising since the early morning, and by noon the lower road could no longer be used. "
    "People carried chairs and boxes up to the church, where the doors stood open and tea was being made."
)
_MIDDLE = "Nobody could say who had called the engineers, but they came before dark and looked at the bridge."
_SHORT = "It held."
_ONE = "Why?"


def _nav(*names: str) -> str:
    return "<nav><ul>" + "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names) + "</ul></nav>"


def _article(*paragraphs: str, head: str = "A wet day") -> str:
    return f"<article><h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"


PAGES: list[list[tuple[int, str]]] = [
    [
        (0, _nav("home", "news", "sport", "about")), (0, '<div class="ad">Buy new boots today and save a lot of money on the second pair.</div>'),
        (1, _article(_LONG, _SHORT, _MIDDLE, _ONE, _LONG)), (0, "<footer>&copy; The Valley Post &middot; All rights reserved by its owners.</footer>"),
    ],
    [
        (0, _nav("start", "archive")), (0, '<div class="ad">Cheap boats.</div>'),
        (1, _article(_SHORT, _ONE, head="Short")), (0, "<footer>&copy; 2020 valley.example</footer>"),
    ],
    [
        (0, "<header><div>The Valley Post</div><p>News from the valley since nineteen hundred and two, every day of the week.</p></header>"),
        (1, "<main><h2>Bridge closed</h2><p>" + _MIDDLE + "</p><p>" + _SHORT + "</p><ul><li>Bring a lamp.</li><li>Wear boots.</li></ul><p>" + _LONG + "</p></main>"),
        (0, '<aside class="sidebar"><h3>Most read</h3><p><a href="/1">' + _MIDDLE + '</a></p><p>' + _LONG + "</p></aside>"),
        (0, '<form><label>Your name</label><button>Send</button><p>We will write to you once a week and never give your address away.</p></form>'),
    ],
    [
        (0, '<div id="cookie-notice"><p>This site uses cookies to keep you signed in. By going on you agree to our terms.</p></div>'),
        (1, '<div class="article-body"><p>' + _LONG + "</p><p>" + _SHORT + "</p><blockquote>" + _MIDDLE + "</blockquote><p>" + _ONE + "</p></div>"),
        (0, '<section id="comments"><h3>Comments</h3><div class="comment"><p>' + _MIDDLE + '</p></div><div class="comment"><p>I saw it too.</p></div></section>'),
    ],
    [
        (1, "<article><h1>Inside</h1><p>" + _MIDDLE + "</p>"), (0, '<div class="advert"><p>' + _LONG + "</p></div>"),
        (1, "<p>" + _LONG + "</p>"), (0, '<aside><p>See also our page on bridges and the people who built them.</p></aside>'),
        (1, "<p>" + _SHORT + "</p>"), (0, '<div class="share">Share this</div><nav><a href="/next">Next</a></nav>'), (1, "<p>" + _ONE + "</p></article>"),
        (0, '<div class="comments"><p>' + _LONG + "</p><p>First!</p></div>"),
    ],
    [
        (0, '<div><a href="/">Home</a> <a href="/b">Bridges</a> <a href="/c">Rivers</a></div>'),
        (1, "<div><p>" + _LONG + "</p><p>" + _MIDDLE + "</p><p>" + _LONG + "</p></div>"),
        (0, '<div><a href="/p">Privacy</a> | <a href="/t">Terms</a></div><div>Contact us</div>'),
    ],
    [
        (0, '<table><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td></tr></table>'),
        (1, "<p>" + _LONG + "</p><p>" + _LONG + "</p><p>" + _MIDDLE + "</p>"), (0, "<div>Back to top</div><div>Print</div>"),
    ],
    [
        (0, '<div class="menu"><ul><li>Fruit</li><li>Bread</li><li>Fish and other things that we bring to your door</li></ul></div>'),
        (1, _article(_MIDDLE, "It <b>held</b> for <a href='/two'>two</a> days.", _LONG, "<a href='/report'>The report</a>", head="Two days")),
        (0, '<div class="notice">The market is closed on Monday because of the holiday in the whole of the valley.</div>'),
        (0, "<footer><p>" + _LONG + "</p><p><a href='/imprint'>Imprint</a></p></footer>"),
    ],
    [
        (0, '<div role="banner">The Post</div>'), (1, '<div id="content"><h1>One line</h1><p>' + _MIDDLE + "</p></div>"),
        (0, '<div role="contentinfo">Written in the valley by people who live there and know it well.</div>'),
    ],
    [
        (0, _nav("a", "b", "c")), (0, '<div class="ad">' + _MIDDLE + " " + _SHORT + "</div>"),
        (1, _article(_ONE, _SHORT, _ONE, _SHORT, "Of.", head="Is it?")), (0, "<footer>&copy; x.example &middot; " + _SHORT + "</footer>"),
    ],
    [
        (0, '<div class="popup"><p>' + _LONG + '</p></div><div hidden><p>' + _LONG + "</p></div>"),
        (1, "<article><p>" + _LONG + "</p><table><tr><td>Height</td><td>4 m</td></tr></table><pre>held = True</pre><figure><figcaption>The bridge at noon</figcaption></figure></article>"),
        (0, '<div class="related"><h4>Related</h4><p>' + _MIDDLE + "</p></div>"),
    ],
    [
        (0, '<div class="newsletter"><p>Get the news of the valley by mail, once a week and free of charge.</p></div>'),
        (1, '<main><article><header><h1>Night</h1></header><p>' + _LONG + "</p><ol><li>" + _MIDDLE + "</li><li>" + _SHORT + "</li></ol></article></main>"),
        (0, '<ul class="social"><li>Follow us</li></ul><div class="sponsor">' + _MIDDLE + "</div>"),
    ],
    [
        (0, "<html class='no-sidebar'><body class='single has-sidebar comments-open'><div id='page' class='no-sidebar'>" + _nav("home", "map")),
        (1, "<div class='content-sidebar-wrap'><article><header class='entry-header'><h1>Low water</h1></header><p title='the hidden river'>" + _LONG + "</p><p>" + _SHORT + "</p></article>"),
        (0, "<div class='sidebar'><p>" + _LONG + "</p></div></div><div class='comments'><article class='comment'><p>" + _MIDDLE + "</p></article></div>"),
        (0, "<footer>&copy; The Valley Post</footer></div></body></html>"),
    ],
    [
        (0, "<body class='comments-open'><div class='page-sidebar-right'>"),
        (1, "<main><div class='post-header'><h1>Ice</h1></div><p>" + _MIDDLE + "</p><p>" + _ONE + "</p></main>"),
        (0, "<div class='related-posts'><article><h3>Bridges</h3><p>" + _MIDDLE + "</p></article></div><div class='footer-wrapper'>" + _LONG + "</div></div></body>"),
    ],
]

"""The labelled table that the block classifier of ``html_text`` is grown on.

A page is a list of (label, markup) pieces, which joined are its HTML: 1 for main text, 0 for anything else.  The label
holds for the blocks that start in the piece.  Small and fixed; written for this purpose.
"""

from __future__ import annotations

S1 = "After twelve years of work the river runs where it ran before the mill was built, and the fields along it are wet again in spring."
S2 = "The town paid for the bridge, the county for the banks, and a society of anglers for the fish, which came by lorry in the night."
S3 = "The guild of bakers has asked the council to let its shops open at four in the morning, as was the custom until the war and for some years after it."
S4 = "A decision is expected in autumn, when the council meets again after the long summer break, and both sides say that they will accept it."
S5 = "Four boats left the harbour on Monday in calm weather, and three of them came back before the storm, with full holds and tired crews."
S6 = "It holds water like a sponge, up to twenty times its weight, and gives it back over days, which is why a wood with moss stays cool."
S7 = "He who sows late must not complain of the frost, say the farmers here, and they sow early."
S8 = "A short walk leads from the station over the brook to the ruin, which is open all year and costs nothing to see."
L1 = "This paper is printed on paper from the valley, as it has been since 1911; write to us at the old mill, call at the office on market days, or leave a note with the baker, who brings it up the hill with the bread every morning but Sunday."
L2 = "I have read your paper for thirty years and my father read it before me, and never once did either of us find the weather right, but we go on reading it all the same, because one has to read something at breakfast and the other paper is worse."
L3 = "Hay is cut when the dew is off it and turned when the sun has been on it for half a day, and whoever brings it in wet may find his barn on fire by August, which is why old men smell at it and shake their heads, whatever the young ones say about the forecast."
T1 = "The bridge over the brook is closed to carts until the end of May."
T2 = "Whoever finds the key to the tower may keep the tower."

PAGES: tuple[tuple[tuple[int, str], ...], ...] = (
    # Pages with an article: its blocks are main text whatever their length; what stands beside it is not.
    (
        (0, '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'),
        (0, "<div>Buy two pairs of shoes and get a third pair for half the price today.</div>"),
        (1, f"<article><h1>River returns to its old bed</h1><p>{S1}</p><p>Nobody complained.</p><p>{S2}</p></article>"),
        (0, "<footer>(c) The Valley Paper, all rights reserved, printed on paper from the valley.</footer></body>"),
    ),
    (
        (0, "<body><header>The Daily Example, since 1911, your paper in town</header><p>Today: rain, and more rain towards the evening, with wind from the west.</p>"),
        (1, f"<article><p>Tea.</p><p>{S7}</p><p>Short.</p><h2>Later</h2><p>No.</p></article>"),
        (0, f"<p>{S8}</p><p>Good.</p></body>"),
    ),
    (
        (0, '<body><div><div><ul><li><a href="/1">One</a></li></ul></div></div>'),
        (1, '<div><article><div><div class="post-header"><h1>On <a href="/k">kites</a></h1></div><p><a href="/k">Kites</a> and <a href="/w">wind</a></p><blockquote>Wind is free, said the old man, and let go of the line.</blockquote></div>'),
        (0, '<div class="share"><p>Tell a friend about this</p><p><a href="/x">Share</a></p></div><div class="comments"><p>Lovely piece about kites, I shall take mine down from the attic and try the hill.</p><p>Good.</p></div></article></div>'),
        (0, '<aside><p>About the author: she walks in woods, writes about what she sees there, and lives with a dog near the sea.</p></aside></body>'),
    ),
    (
        (1, f"<body><article><h1>Snow</h1><p>It fell all night and lay a yard deep on the pass, so that the mail came three days late.</p><p>{S4}</p>"),
        (0, '<div class="ad">Skis, poles and boots from the old mill, all at half the price until Sunday.</div>'),
        (1, "<p>Nobody minded."),
    ),
    # Linked paragraphs of an article: one alone is text, several in a row are a list of other pages.
    (
        (1, f'<body><article><p>{S5}</p><p><a href="/f">The report of the harbour master, in full</a></p><p>{S6}</p><p>So it goes.</p>'),
        (0, '<ul><li><a href="/1">Ten walks to take before the first snow falls in the hills</a></li><li><a href="/2">What the new timetable means for those who live by the lake</a></li><li><a href="/3">Boats for sale</a></li></ul>'),
        (1, f"<p>{S3}</p></article></body>"),
    ),
    (
        (1, f'<body><main><h1>Notes on moss</h1><p>Moss grows slowly.</p><p>{S6}</p><p><a href="/a">An old picture of it</a></p><p>{S8}</p><ul><li>Peat moss</li><li>Hair moss, common on <a href="/h">heaths</a></li></ul></main>'),
        (0, '<form>Subscribe to our letter and never miss a piece <label>Your address</label></form><div class="notice">We use cookies to measure how our pages are read; by reading on you agree to this use of cookies.</div></body>'),
    ),
    (
        (1, f"<body><main><article><h1>Clocks</h1><p>{S4}</p><p>Late.</p></article>"),
        (0, '<p><a href="/r">More on clocks</a></p><p><a href="/s">More on bells</a></p></main><footer><p>Imprint</p></footer></body>'),
    ),
    # Pages without an article: long unlinked blocks are main text, short ones by what stands on both sides of them.
    (
        (0, '<body><div><a href="/1">Politics</a> <a href="/2">Trade</a> <a href="/3">Weather</a></div>'),
        (1, f"<div><h2>Bakers ask for earlier opening hours</h2><p>{S3}</p><p>So be it.</p><p>{S4}</p></div>"),
        (0, '<div><a href="/r">More on bread</a></div>'),
        (0, '<div class="comments"><p>I have bought my bread there for thirty years and never once found the door closed when I came in the morning.</p><p>Good.</p></div></body>'),
    ),
    (
        (0, '<body><p><a href="/a">Start</a> | <a href="/b">Contact</a></p>'),
        (1, f"<p>{S5}</p><p>All were safe.</p><p>The fourth was found on Wednesday near the cape, its crew safe and well, its engine broken, its nets lost somewhere to the north.</p>"),
        (0, '<p><a href="/i">Imprint</a></p><p>Print this page</p></body>'),
    ),
    (
        (0, "<body><p>Menu</p><p>Print this page</p>"),
        (1, f"<h1>The old clock is to be mended at last</h1><p>For nine years the clock over the gate has shown ten to four, and the town has grown used to being early for its tea.</p><p>Nobody asked why.</p><p>{S2}</p>"),
        (0, "<p>Send to a friend</p><p>Back to top</p></body>"),
    ),
    (
        (0, "<body><p>Back to top</p><p>Login</p>"),
        (1, f"<div>{S8}</div><div>Bring water.</div><div>{S1}</div>"),
        (0, "<div>Top of page</div><div>Site map</div></body>"),
    ),
    (
        (0, '<body><ul><li><a href="/1">Ten walks to take before the first snow falls in the hills</a></li><li><a href="/2">What the new timetable means for those who live by the lake</a></li></ul>'),
        (1, '<p>The ferry stops at nine in winter and the last bus meets it, unless fog holds up the one or the other (see the <a href="/t">timetable</a>).</p>'),
        (0, '<p><a href="/3">Read also: how the lake got its name and lost it again</a></p></body>'),
    ),
    # Long blocks that are not main text: beside an article, in furniture, in a part of a page that is called so.
    (
        (0, f"<body><div><p>{L1}</p></div>"),
        (1, f"<article><h1>Hay</h1><p>{S1}</p><p>Dry.</p><p>{L3}</p><p>{S7}</p></article>"),
        (0, f"<div><p>{L2}</p><p>{S8}</p></div><footer><p>{L1}</p></footer></body>"),
    ),
    (
        (0, f"<body><nav><p>{L2}</p></nav><p>{L1}</p>"),
        (1, f"<article><p>{L3}</p><p>Yes.</p>"),
        (0, f"<aside><p>{L1}</p></aside><form><p>{L2}</p></form><div class='promo'><p>{L2}</p><p>{S2}</p></div>"),
        (1, f"<p>{S3}</p></article>"),
        (0, f"<section id='comments'><p>{L2}</p><p>{L1}</p></section></body>"),
    ),
    (
        (0, f"<body><header><p>{L1}</p></header><div class='cookie-notice'><p>{L2}</p></div>"),
        (1, f"<h1>Rye</h1><p>{S1}</p><p>{L3}</p>"),
        (0, f"<div class='user-comments'><p>{L2}</p><p>{L3}</p></div><footer><p>{L2}</p></footer></body>"),
    ),
    (
        (0, f'<body><ul><li><a href="/1">{L1}</a></li><li><a href="/2">{L2}</a></li></ul>'),
        (1, f"<p>{T1}</p><p>{S1}</p><p>{T2}</p>"),
        (0, f'<p><a href="/3">{S2}</a></p></body>'),
    ),
    ((1, f"<body><p>{T1}</p></body>"),),
    ((1, f"<body><p>{T2}</p><p>{T1}</p></body>"),),
    ((0, '<body><p><a href="/">Start</a></p>'), (1, f"<p>{T2}</p>"), (0, "<p>Top of page</p></body>")),
    ((1, f"<body><p>{S7}</p>"), (0, "<p>Top of page</p></body>")),
    ((1, f"<div>{S4}</div>"),),
    ((1, f"<body><table><tr><td><p>{S5}</p><p>One came late.</p><p>{S6}</p></td>"), (0, '<td><a href="/x">Links</a></td></tr></table></body>')),
    (
        (0, '<body><div class="menu"><p>Fish</p><p>Our boats go out every day but Sunday, and the shop opens when they are back in the harbour.</p></div>'),
        (1, f"<h1>What the sea gave this year</h1><p>{S5}</p><p>{S1}</p>"),
        (0, '<div id="sidebar"><p>The weather at sea will stay calm until Friday, with some rain on the coast and snow further inland.</p></div></body>'),
    ),
    (
        (0, '<body><p>Page 3</p><p><a href="/2">Back</a></p>'),
        (1, f"<p>{S2}</p><p>That was all.</p><p>{S7}</p><p>Or not.</p><p>{S3}</p>"),
        (0, '<p><a href="/4">On</a></p><p>Page 3</p></body>'),
    ),
    # Depth alone says nothing: articles at the top of a page, and pages without one deep in containers.
    ((1, f"<article><p>One.</p><p>Two, three.</p><p>{S1}</p><p>Four.</p></article>"),),
    ((1, "<article><p>Five.</p></article>"),),
    ((1, "<article><h1>Six</h1><p>Seven.</p></article>"), (0, f"<p>{S3}</p>")),
    ((1, "<main><p>Eight.</p><p>Nine is a number too.</p></main>"), (0, f"<div><p>Ten.</p><p>{S4}</p></div>")),
    (
        (0, '<body><div><div><div><div><p><a href="/">Start</a></p><p>Print this page</p><p>Send this page to a friend by mail</p>'),
        (1, f"<h1>Long walks in the hills above the lake</h1><p>{S8}</p><p>Go early.</p><p>{S5}</p><h2>Back again</h2><p>{S6}</p>"),
        (0, '<p>Write to us</p><p>Sign here for our letter every week</p><p><a href="/">Start</a></p></div></div></div></div></body>'),
    ),
    (
        (0, "<body><div><section><div><div><div><p>All pages of this paper</p><p>Find a page</p>"),
        (1, f"<h2>The mill is sold</h2><div>{S1}</div><div>Who bought it?</div><div>{S2}</div><div>{T2}</div>"),
        (0, "<div>To the top of this page</div><div>Help</div></div></div></div></section></div></body>"),
    ),
    (
        (0, "<body><div><div><p>Today in the paper</p><p>Letters</p><p>The price of eggs</p></div>"),
        (1, f"<div><p>{L3}</p><p>Who would not?</p><p>{S3}</p><p>Not I, said the baker.</p><p>{S4}</p></div>"),
        (0, "<div><p>Printed in the valley since 1911</p><p>Write to us at the mill</p></div></div></body>"),
    ),
    # A linked headline is text.
    ((1, f'<article><h1><a href="/m">Moss</a></h1><p>{S6}</p></article>'),),
    ((1, f'<article><h2><a href="/o">Oats, and who eats them</a></h2><p>Some do.</p><p>{S1}</p></article>'),),
    # A linked paragraph is text, long or short as it and what stands around it may be; several in a row are a list.
    *(
        (
            (1, f"<article>{outer}<p>{before}</p><p><a href='/l'>{link}</a></p><p>{after}</p><p>{S7}</p>"),
            (0, f"<p><a href='/1'>{link}</a></p><p><a href='/2'>{link}</a></p><p><a href='/3'>{link}</a></p>"),
            (1, f"<p>{before}</p></article>"),
        )
        for outer, link, before, after in (
            ("", T2, "So it is.", S5),
            ("", S3, S1, "Or not."),
            ("<div>", "Elm", L3, S2),
            ("<div><section>", "Oak and ash", "Four more.", "And five."),
            ("<div><section><div>", L2, S8, S4),
            ("<section>", S6, "Why?", L1),
        )
    ),
)

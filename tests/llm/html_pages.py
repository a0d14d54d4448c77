"""Pages of templates that training never sees, written and labelled by hand: blocks of the main text begin with a plus."""

PAGES = {
    "blog": """<body class="home single"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><div class="site-branding">
      <p class="site-title"><a href="/">The Tide Blog</a></p><p class="site-description">Notes from the shore</p></div><nav id="site-navigation">
      <ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav></header><div id="content" class="site-content">
      <div id="primary"><main id="main" class="site-main"><article id="post-17" class="post type-post hentry"><header class="entry-header">
      <h1 class="entry-title">+Why the sea rises twice</h1><div class="entry-meta">Posted on 3 May by Ann</div></header><div class="entry-content">
      <p>+Most coasts see two high waters in a day, and the reason is not only the moon above them but the turning of the earth.</p>
      <h2>+Spring and neap</h2><p>+When sun and moon stand in line their pulls add up, and the range between high and low water is at its greatest.</p>
      <ul><li>+Spring tides follow new and full moon</li><li>+Neap tides follow the quarters</li></ul>
      <blockquote><p>+Time and tide wait for no one, as the old saying goes among sailors.</p></blockquote>
      <p>+In narrow bays the water piles up further, so that ranges of over ten metres are known from a few places.</p></div>
      <footer class="entry-footer">Posted in Sea, Science</footer></article><div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2>
      <ol class="comment-list"><li class="comment"><div class="comment-content"><p>I live by such a bay and the noise of the returning water is something to hear at night.</p></div></li>
      </ol></div></main></div><aside id="secondary" class="widget-area"><section class="widget"><h3 class="widget-title">Recent posts</h3>
      <ul><li><a href="/x">On sand</a></li></ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly self hosted</div></footer></div></body>""",
    "bem": """<body><div class="l-page"><div class="c-header"><div class="c-header__logo">Daily Courier</div><ul class="c-nav"><li><a href="/w">World</a></li>
      <li><a href="/s">Sport</a></li></ul></div><div class="l-main"><div class="article"><h1 class="article__title">+Bridge reopens after two years</h1>
      <div class="article__meta">Tuesday, 9.30</div><div class="article__body"><p>+The bridge over the northern arm of the river was opened to traffic again this morning, two years after it had been closed.</p>
      <p>+Engineers replaced forty bearings and most of the deck while trains went on running below.</p><div class="ad ad--inline">Buy two tyres, get one free</div>
      <p>+Residents said they were glad to see the long way round come to an end.</p></div></div></div><div class="c-footer"><p>Imprint</p><p>Privacy</p></div></div></body>""",
    "table layout": """<body bgcolor="white"><table width="100%"><tr><td colspan="2"><a href="/">Home</a> | <a href="/m">Map</a></td></tr><tr><td class="leftmenu">
      <a href="/1">Rocks</a><br><a href="/2">Minerals</a></td><td class="maintext"><h1>+Granite and its kin</h1>
      <p>+Granite is a coarse rock that cools slowly at depth, so that its crystals have time to grow to a size that the eye can see.</p>
      <p>+It holds quartz, feldspar and mica in changing shares, and it weathers into rounded blocks.</p></td></tr>
      <tr><td colspan="2" class="footer">Last updated 4 June 2003</td></tr></table></body>""",
    "bare": """<html><head><title>Bread</title></head><body><h1>+A plain loaf</h1><p>+Mix the flour with water and leave it alone for an hour before the salt goes in, since salt slows the yeast down.</p>
      <p>+Fold the dough four times over two hours and let it rest overnight in a cold place.</p><ol><li>+Heat the oven with the pot inside</li><li>+Bake covered for half an hour</li></ol>
      <pre>+500 g flour 350 g water 10 g salt</pre></body></html>""",
    "documentation": """<body><header class="navbar"><a href="/">Toolkit</a></header><div class="container"><nav class="toc"><ul><li><a href="#a">Install</a></li>
      <li><a href="#b">Use</a></li></ul></nav><main role="main" class="markdown"><h1>+Getting started</h1><p>+The toolkit runs wherever a shell runs and needs no other program to be present on the machine.</p>
      <h2>+Install</h2><pre>+fetch toolkit and unpack it</pre><p>+After this the command is found on the path of the current user, and its manual can be read without a network.</p>
      <table><tr><th>+Flag</th><th>+Meaning</th></tr><tr><td>+-v</td><td>+say more</td></tr></table></main></div><footer><p>Built from revision 12</p></footer></body>""",
    "news with rail": """<body><div class="cookie-consent"><p>This site stores cookies on your device to remember what you have read and to measure its audience.</p><button>Accept</button></div>
      <div id="top"><form class="search-form"><label>Find</label></form></div><div class="columns"><div class="story"><h1>+Harvest starts early in the valley</h1><p class="byline">By our own reporter</p>
      <div class="share-tools"><ul><li>Mail</li><li>Print</li></ul></div><div class="story-text"><p>+Growers in the valley have begun to pick ten days before the usual date after a dry and very warm summer.</p>
      <figure><img src="x.jpg"><figcaption>+Pickers on the southern slope on Monday</figcaption></figure><p>+Yields are expected to be small but of good quality, the union of growers said.</p>
      <div class="newsletter-signup"><p>Get the morning letter in your mailbox every day before six</p></div><p>+Rain is forecast for the end of the week, which may slow the work.</p></div></div>
      <div class="right-rail"><h3>Most read</h3><ul><li><a href="/1">Road to be closed</a></li><li><a href="/2">School wins prize</a></li></ul><p>Our photographers show the best pictures they took in the valley over the last week in a long gallery.</p></div></div></body>""",
    "forum answer page": """<body><div class="topbar">Sign in</div><div id="main-content"><article class="question"><h1>+How to sharpen a plane iron</h1>
      <p>+Flatten the back first on a coarse stone and only then work on the bevel, which wants an angle of about twenty five degrees.</p>
      <p>+Finish on a fine stone with light strokes until the wire edge falls off by itself.</p></article></div>
      <section class="user-comments"><div class="comment"><p>I use a strop with green paste at the end, and it makes quite a difference on soft wood.</p></div>
      <div class="comment reply"><p>So do I, for twenty years now, and never had a complaint about it.</p></div></section><div class="login-box"><form><p>Log in to write a comment</p></form></div></body>""",
    "magazine": """<div class="wrapper"><div class="banner-top">Advertisement</div><div class="menu-main"><a href="/">Front</a> <a href="/c">Culture</a></div>
      <section class="post-single"><div class="post-single-head"><h1>+The last clockmaker of the street</h1></div><div class="post-single-content">
      <p>+He opens at nine, closes at five, and in between he bends over movements that are older than anyone who brings them.</p>
      <h3>+A trade with few heirs</h3><p>+Two apprentices have come and gone in ten years, and neither of them stayed in the trade.</p>
      <aside class="pullout"><p>See also our series on old trades</p></aside><p>+When he retires the shop will be a place for coffee, he says, and shrugs.</p></div></section>
      <div class="related-articles"><h4>You may like</h4><ul><li><a href="/x">The last printer</a></li></ul></div><div id="footer"><ul><li>Contact</li><li>Terms</li></ul></div></div>""",
    "encyclopedia": """<body><div id="mw-head"><ul><li><a>Read</a></li><li><a>History</a></li></ul></div><div id="content" class="body-content" role="main"><h1 class="firstHeading">+Heron</h1>
      <div class="siteNotice notice">Help us to keep this work free of charge by a gift</div><div class="parser-output"><p>+Herons are long legged birds of the waterside which hunt by standing still and striking at passing fish.</p>
      <h2>+Range</h2><p>+They live on all continents but the southernmost one, and many of the northern ones migrate.</p><ul><li>+Grey heron</li><li>+Purple heron</li></ul></div></div>
      <div id="mw-panel" class="sidebar"><ul><li><a>Random page</a></li></ul></div><div id="footer" role="contentinfo"><ul><li>Text is free to share</li></ul></div></body>""",
    "product note": """<body><nav><a href="/">Shop</a><a href="/b">Basket</a></nav><div class="page-wrap"><main><div class="content-block"><h2>+Care of wool</h2><div>+Wash wool by hand in cool water and press it dry between towels, and never wring it.</div>
      <div>+Dry it flat and away from the sun, for both heat and light make the fibres brittle in the long run.</div></div><form action="/subscribe"><p>Your address</p><button>Send</button></form></main>
      <div class="popup-modal"><p>Ten per cent off your first order when you join our list today</p></div></div><footer class="foot"><div>Delivery</div><div>Returns</div></footer></body>""",
    "essay in sections": """<body><header><div>Collected Essays</div></header><article itemscope><header><h1>+On walking</h1><p class="author">M. Hale</p></header><section><h2>+One</h2>
      <p>+There is a kind of thought that comes only on foot, and leaves again the moment one sits down to write it out.</p></section><section><h2>+Two</h2>
      <p>+It is slow, it goes in circles, and it minds the weather more than the argument.</p><dl><dt>+Pace</dt><dd>+slow enough to look</dd></dl></section>
      <footer><p>Filed under walking</p></footer></article><nav class="pagination"><a href="/1">Older</a><a href="/3">Newer</a></nav><footer>All rights reserved</footer></body>""",
    "agency": """<body><div class="site-header"><div class="logo">Agency</div></div><div class="breadcrumbs"><a href="/">Start</a> / <a href="/n">Notes</a></div><div class="container"><div class="row"><div class="col-8">
      <div class="node-content"><h1>+Water levels fall across the south</h1><div class="date">11 August</div><p>+Levels in the southern reservoirs fell by a fifth over July, the office for water said on Monday.</p>
      <p>+Farmers were asked to draw water by night only, and towns to leave their fountains dry.</p></div><div class="social"><p>Share this</p></div></div><div class="col-4 sidebar-right"><div class="widget"><p>Subscribe to alerts</p></div></div></div></div>
      <div class="site-footer"><p>Copyright the agency</p></div></body>""",
}

#: Written after the training was settled, and not looked at while it was.
LATER = {
    "recipe": """<body><header class="site-head"><a href="/">Kitchen</a><form role="search"><input><button>Go</button></form></header><div class="layout"><article class="recipe">
      <h1>+Lentil soup</h1><div class="recipe-meta">Serves four</div><div class="recipe-body"><p>+Wash the lentils and let them drain while the onions turn soft in the oil over a low flame.</p>
      <ol><li>+Add the lentils and the stock</li><li>+Simmer for forty minutes</li></ol><div class="promo-box"><p>Win a set of pans in our summer draw</p></div>
      <p>+Season at the end, since salt keeps the skins firm.</p></div></article><aside class="more"><h3>More soups</h3><ul><li><a href="/p">Pea soup</a></li></ul></aside></div><footer>Kitchen 2019</footer></body>""",
    "town council": """<body><div id="kopf" class="header"><h2>Town of Lower Bridge</h2></div><div class="navigation nav"><ul><li><a href="/1">Council</a></li><li><a href="/2">Services</a></li></ul></div>
      <div class="breadcrumb">You are here: Council</div><div class="content"><h1>+New opening hours at the town hall</h1><p>+From the first of the month the town hall opens at eight and closes at noon, but for Thursdays, when it stays open until six.</p>
      <table><tr><td>+Monday</td><td>+8 to 12</td></tr><tr><td>+Thursday</td><td>+8 to 18</td></tr></table><p>+Requests by letter are dealt with as before.</p></div><div class="footer"><p>Imprint</p></div></body>""",
    "science desk": """<body><div class="consent-banner"><p>We and our partners store data on your device to show you adverts that suit you.</p></div><div class="page"><main><article class="article-page"><header><h1>+A moon with a sea</h1>
      <div class="author-line byline">Words by L. Orr</div></header><div class="lead"><p>+Under a shell of ice some kilometres thick lies more water than in all oceans of the earth.</p></div><div class="article-text"><h2>+How it stays warm</h2>
      <p>+The pull of its planet kneads the moon as it goes round, and the rubbing of rock on rock gives off heat.</p><figure><figcaption>+The cracked face of the moon</figcaption></figure><div class="ad-slot ad">Telescopes from ninety</div>
      <p>+A craft is on its way and will arrive in six years.</p></div></article><section class="comments"><h3>Comments</h3><p>I wonder if anything swims there, though I doubt we will know in my time.</p></section></main></div></body>""",
    "plain notes": """<body><p><a href="index.html">Up</a></p><h1>+Notes on knots</h1><p>+The bowline makes a loop that does not slip and that can be undone after it has borne a load.</p><p>+The sheet bend joins two ropes of different girth.</p><hr><p>+The clove hitch is quick, and it slips when pulled from the side.</p></body>""",
    "gazette": """<body><div class="masthead"><p>The Gazette</p></div><nav class="sections"><ul><li><a>Town</a></li><li><a>Land</a></li></ul></nav><section class="news-story story"><div class="headline-box"><h1>+Library stays open</h1></div>
      <p class="date">Wednesday</p><div class="story-content"><p>+The council voted last night to keep the branch library open for three more years at least.</p><p>+Its friends had gathered four thousand names.</p><blockquote>+We are more than relieved, their chair said.</blockquote></div>
      <div class="share-bar share"><ul><li>Post</li><li>Send</li></ul></div></section><div class="sidebar"><div class="box"><h4>Weather</h4><p>Cloudy in the morning with some rain towards the evening and light wind from the west.</p></div></div><div class="bottom footer-links footer"><a>About</a></div></body>""",
    "manual page": """<body><div class="sphinx-sidebar sidebar"><ul><li><a>Index</a></li><li><a>Modules</a></li></ul></div><div class="document"><div class="body" role="main"><section><h1>+Queues</h1><p>+A queue hands out its items in the order in which they were put in.</p><pre>+q = queue()</pre>
      <dl><dt>+put</dt><dd>+adds an item at the end and wakes whoever waits for one</dd></dl></section></div></div><div class="related nav"><ul><li><a>next</a></li></ul></div><div class="footer">Made by hand</div></body>""",
    "travel": """<body><div class="top-menu menu"><ul><li>Trips</li><li>Hotels</li></ul></div><div class="wrap"><div class="main"><div class="post-wrap"><h1>+Three days on the island</h1><div class="post-date date">July</div><div class="post-text"><p>+The ferry leaves at six and there is nothing to do but to sleep on deck until the cliffs come up.</p><h3>+Day one</h3><p>+We walked the length of it and met two goats and a priest.</p>
      <ul><li>+Bring water</li><li>+Bring a hat</li></ul></div></div><div class="newsletter"><p>Travel tips in your mailbox every Friday</p></div><div id="respond"><h3>Leave a comment</h3><form><p>Your name</p></form></div></div><div class="right sidebar"><ul><li><a>Maps</a></li></ul></div></div></body>""",
    "old home page": """<center><table border="0"><tr><td class="nav"><a href="a.htm">Me</a> <a href="b.htm">Dogs</a></td></tr><tr><td class="content"><h2>+My first radio</h2><p>+It had one valve and a coil wound on a card tube, and it picked up a station across the sea after dark.</p><p>+My father held the aerial out of the window.</p></td></tr><tr><td class="bottom">Visitors: 1204</td></tr></table></center>""",
}

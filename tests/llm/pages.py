"""Pages written by hand, unlike the layouts that the model learns from: (html, the article's blocks)."""

BLOG = """<!doctype html><html lang=en><head><title>Keeping bees</title><link rel=stylesheet href=x.css><script>document.write("<p>not text</p>")</script></head>
<body class="post-template single postid-77 has-sidebar">
<a class="skip-link" href="#c">Skip to content</a>
<div id="masthead"><div class="site-branding"><p class="site-title"><a href="/">Garden Notes</a></p><p>Just another weblog</p></div>
<div class="main-navigation"><ul><li><a href="/">Home</a><li><a href="/about">About</a><li><a href="/contact">Contact us</a></ul></div></div>
<div id="primary"><div class="hentry"><h1 class="entry-title">Keeping bees in&nbsp;town</h1>
<div class="entry-content"><p>Last spring we put two hives on the roof of the school, and nobody noticed them until June.
<p>It is easier than it looks: a hive needs water, shade &amp; a quiet corner.</p>
<div class="ad-box-300">Save 20% on bee suits this week only!</div>
<h2>What you need</h2><ul><li>A smoker</li><li>Gloves that reach the elbow</li></ul>
<p>Ask your neighbours first. They will be glad of the honey.</p></div>
<div class="sharedaddy"><h3>Share this:</h3><ul><li><a href="#">Facebook</a></li><li><a href="#">Twitter</a></li></ul></div></div>
<div id="comments" class="comments-area"><h2>2 thoughts on &ldquo;Keeping bees&rdquo;</h2><ol class="comment-list"><li><div class="comment-author">Ann</div><p>We tried this in Leeds and lost both colonies in the first winter, sadly.</p></li>
<li><p>Thank you for writing this, it helped me to decide.</p></li></ol>
<div id="respond"><h3>Leave a Reply</h3><form><p>Your email address will not be published.</p><label>Name</label><input><textarea>type here</textarea></form></div></div></div>
<div id="secondary" class="widget-area"><h2>Recent posts</h2><ul><li><a href=1>Pruning roses</a></li><li><a href=2>Compost for beginners</a></li></ul></div>
<div id="colophon">Proudly powered by a blog engine &copy; 2021</div></body></html>"""
BLOG_BLOCKS = [
    "Keeping bees in town", "Last spring we put two hives on the roof of the school, and nobody noticed them until June.", "It is easier than it looks: a hive needs water, shade & a quiet corner.",
    "What you need", "A smoker", "Gloves that reach the elbow", "Ask your neighbours first. They will be glad of the honey.",
]

NEWS = """<html><body><div class="gdpr-overlay"><p>We value your privacy. We and our partners store information on a device.</p><button>Agree</button></div>
<header><nav><a href=/>News</a> <a href=/s>Sport</a> <a href=/w>Weather</a></nav></header>
<main><article><h1>Council votes to close the bridge</h1><p>The vote was close. Eleven members were in favour, nine against.</p>
<aside><h4>Related</h4><p><a href=/1>Bridge inspection finds rust in the main cable</a></p></aside>
<p>Drivers will have to cross the river at Northgate, eight miles away.</p><blockquote>We had no choice.</blockquote>
<figure><img src=b.jpg alt=""><figcaption>The bridge in 1931</figcaption></figure><p>Work begins in May.</p></article>
<section class="reader-comments"><h3>Reader comments</h3><article class="comment"><p>This is a terrible decision and the council should think again.</p></article></section></main>
<footer><p>&copy; The Northgate Mail. <a href=/p>Privacy</a> <a href=/t>Terms</a></p></footer></body></html>"""
NEWS_BLOCKS = [
    "Council votes to close the bridge", "The vote was close. Eleven members were in favour, nine against.", "Drivers will have to cross the river at Northgate, eight miles away.",
    "We had no choice.", "The bridge in 1931", "Work begins in May.",
]

TABLE = """<HTML><BODY BGCOLOR=white><TABLE WIDTH=700><TR><TD COLSPAN=2><A HREF=/><IMG SRC=logo.gif></A> <A HREF=a.htm>Products</A> | <A HREF=b.htm>Support</A> | <A HREF=c.htm>Jobs</A></TD></TR>
<TR><TD CLASS=leftnav><A HREF=1>Overview</A><BR><A HREF=2>Downloads</A><BR><A HREF=3>Manuals</A></TD><TD CLASS=content><H1>Cleaning the pump</H1><P>Turn the pump off and let it cool for an hour.
<P>Take the lid off. Rinse the filter under warm water, never hot, and dry it before you put it back.</TD></TR><TR><TD CLASS=foot>Copyright 1999 Acme Pumps. All rights reserved.</TD></TR></TABLE>"""
TABLE_BLOCKS = ["Cleaning the pump", "Turn the pump off and let it cool for an hour.", "Take the lid off. Rinse the filter under warm water, never hot, and dry it before you put it back."]

GERMAN = """<html><body><div class="cookie-hinweis" id="cookieConsent">Diese Seite verwendet Cookies. <a href=#>Mehr erfahren</a></div><div class="navigation"><ul><li><a>Startseite</a></li><li><a>Politik</a></li></ul></div>
<div class="artikel article"><h1>Der lange Sommer</h1><p>Seit Mai hat es kaum geregnet, und die Bauern sorgen sich um ihre Ernte.</p><div class="werbung ad">Anzeige: Jetzt günstig versichern.</div><p>Im Norden ist die Lage besser.</p></div>
<div class="sidebar-teaser"><h3>Meistgelesen</h3><a>Neue Regeln für Radfahrer</a></div><div class="kommentare"><p>Bei uns im Garten ist alles vertrocknet, so etwas habe ich noch nie erlebt.</p></div><div class="footer">Impressum | Datenschutz</div></body></html>"""
GERMAN_BLOCKS = ["Der lange Sommer", "Seit Mai hat es kaum geregnet, und die Bauern sorgen sich um ihre Ernte.", "Im Norden ist die Lage besser."]

PAGES = [(BLOG, BLOG_BLOCKS), (NEWS, NEWS_BLOCKS), (TABLE, TABLE_BLOCKS), (GERMAN, GERMAN_BLOCKS)]

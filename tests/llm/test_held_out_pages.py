"""The page model on pages that nobody generated: written by hand after it, with class names that MEANING has not.

Neither the model nor its specimens were tuned on them, and they are not to be.
"""

from cladeflow.llm import html_text

# (page, what begins or marks its blocks of main text, the same of blocks that are none)
# fmt: off
PAGES = [
("""<!doctype html><html><head><title>Harbour</title></head><body>
<div class="masthd"><a href="/">The Quay</a><span class="tagln">News from the water since 1911</span></div>
<div class="gnb"><a href="/w">Weather</a> <a href="/t">Tides</a> <a href="/m">Moorings</a> <a href="/j">Jobs</a></div>
<div class="lyt"><div class="colA">
<h1>Dredger returns to the inner basin</h1>
<p>After eleven weeks in dry dock, the dredger Marta went back to work on Tuesday, and the first loads of silt were taken out past the bar before noon.</p>
<p>Harbour staff said that the basin had lost almost a metre of depth since the spring, which kept two of the larger trawlers at the outer wall.</p>
<h2>What comes next</h2>
<p>The work is planned for six weeks. Boats on pontoons C and D will be moved for some days, and their owners hear of it by letter.</p>
</div><div class="colB"><h3>Elsewhere</h3><ul><li><a href="/1">Ferry times change</a></li><li><a href="/2">A new crane</a></li><li><a href="/3">Lost buoy found</a></li></ul></div></div>
<div class="btm"><a href="/i">Imprint</a> <a href="/p">Privacy</a> Copyright The Quay</div></body></html>""",
 ["Dredger returns to the inner basin", "After eleven weeks", "Harbour staff said", "What comes next", "The work is planned"],
 ["The Quay", "Weather", "Ferry times change", "A new crane", "Imprint"]),
("""<html><body><table width=100%><tr><td><a href=a>Index</a> <a href=b>Pictures</a> <a href=c>Guests</a></td></tr></table>
<center><h1>How to prune an old apple tree</h1></center>
<p>Start in late winter, when the tree is bare and the worst of the frost is over. Take out dead and broken wood first.
<p>Then look for branches that cross. Of two that rub, the weaker one goes; cut it at the collar, not flush with the trunk.
<ol><li>Never take more than a quarter of the crown in a year.<li>Keep the tools sharp and clean.<li>Leave the wounds open to the air.</ol>
<p>An old tree that was neglected for decades needs three or four winters, and it will answer with water shoots each summer.
<hr><form action=/cgi><p>Find in these pages: <input name=q><input type=submit value=Find></form>
<a href=a>Index</a> | <a href=b>Pictures</a></body></html>""",
 ["How to prune an old apple tree", "Start in late winter", "Then look for branches", "Never take more", "Keep the tools sharp", "Leave the wounds open", "An old tree that was"],
 ["Index", "Guests", "Find in these pages"]),
("""<html><body><div id="top7"><div class="lg">Kernel Notes</div><ul class="u1"><li><a href="/">Start</a></li><li><a href="/arch">Archive</a></li><li><a href="/rss">RSS</a></li></ul></div>
<article><h1>A queue without locks</h1><p>Two indices are enough for one producer and one consumer, provided that each side writes only its own.</p>
<pre>head = (head + 1) % size</pre>
<p>The reader may see an old value of the head; then it finds the queue emptier than it is, which costs a turn but does no harm.</p>
<blockquote><p>What is not shared need not be guarded.</p></blockquote></article>
<div class="cmts"><h2>3 remarks</h2><div class="cm"><b>ada</b> <p>Does this hold on weakly ordered machines as well? I doubt it.</p></div><div class="cm"><b>lin</b> <p>You need a release store there.</p></div><div class="cm"><b>ada</b> <p>Thanks, that makes sense to me now.</p></div></div>
<div class="fin">Kernel Notes, 2019. Made by hand.</div></body></html>""",
 ["A queue without locks", "Two indices are enough", "head = (head + 1) % size", "The reader may see", "What is not shared"],
 ["Archive", "3 remarks", "Does this hold on", "You need a release", "Thanks, that makes", "Made by hand"]),
("""<html><body><div class="ck-bar"><p>This site stores small files on your machine. Go on to agree.</p><button>Agree</button></div>
<nav><ul><li><a href="/">Home</a><li><a href="/soups">Soups</a><li><a href="/bread">Bread</a></ul></nav>
<main><h1>Lentil soup for eight</h1><p>This is the soup that my aunt made on Saturdays, thick enough for a spoon to stand in it.</p>
<h2>What you need</h2><ul><li>500 g brown lentils</li><li>2 onions and 3 carrots</li><li>1 bay leaf</li><li>2 litres of stock</li></ul>
<h2>What you do</h2><p>Sweat the onions and carrots in oil, add lentils, leaf and stock, and simmer for forty minutes.</p><p>Salt it at the end only, or the lentils stay hard.</p>
<div class="zz-k1"><a href="/shop">Knives at half the price this week</a></div></main>
<aside><h3>Cook next</h3><p><a href="/9">Barley broth</a></p><p><a href="/8">Pea soup</a></p></aside>
<footer><p>Written and cooked in Leith.</p></footer></body></html>""",
 ["Lentil soup for eight", "This is the soup that", "What you need", "500 g brown lentils", "2 onions and 3 carrots", "1 bay leaf", "2 litres of stock", "What you do", "Sweat the onions", "Salt it at the end"],
 ["stores small files", "Soups", "Knives at half", "Barley broth", "Written and cooked"]),
("""<html><body><div class="w"><div class="h">Council of Harrow Vale</div><div class="n"><a href="1">Services</a><a href="2">Meetings</a><a href="3">Payments</a></div>
<div class="c"><div class="t">Changes to waste collection</div><div>From the first week of May, paper and card are collected every second Wednesday instead of each Friday.</div>
<div>Bins are to stand at the kerb by seven in the morning. Crews do not come back for bins that were put out late, except for residents on the assisted list.</div>
<div>Questions are answered at the town hall, room 12, on weekdays from nine to four.</div></div>
<div class="s"><div>Quick ways</div><a href="4">Report a pothole</a><a href="5">Pay a fine</a></div><div class="f">Harrow Vale Council, Market Square 1</div></div></body></html>""",
 ["Changes to waste collection", "From the first week", "Bins are to stand", "Questions are answered"],
 ["Council of Harrow Vale\n", "Meetings", "Report a pothole", "Market Square 1"]),
]
# fmt: on


def test_class_names_say_nothing():
    tokens = [t for page, _, _ in PAGES for t in html_text.NAMED.findall(page)]
    assert len(tokens) > 20 and not any(html_text.meanings(f"class={t}") for t in tokens)


def test_blocks_found_and_dropped():
    texts = html_text.extract_texts([page for page, _, _ in PAGES], html_text.trained())
    found = sum(g in t for (_, good, _), t in zip(PAGES, texts, strict=True) for g in good)
    wrong = sum(b in t + "\n" for (_, _, bad), t in zip(PAGES, texts, strict=True) for b in bad)
    every = sum(len(good) for _, good, _ in PAGES)
    # Measured: 30 of 31 found, 1 wrong. A line of a comment is kept, a heading in a plain <div> is lost.
    assert found >= 0.9 * every and wrong <= 0.1 * every

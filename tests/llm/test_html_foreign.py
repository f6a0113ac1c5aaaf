"""Word precision and recall of the block labeller on pages of templates that its training pages don't have, written by hand."""

from collections import Counter

from loomline.llm import html_text

RIVER = ["The river that changed its course", "For three summers the gauges upstream had shown less water than anyone could remember, and nobody in the valley office was surprised.",
         "When the dam was opened in April, engineers expected the old channel to fill within a week. It took four.", "What happened next", "Farmers on the eastern bank dug trenches by hand, and the first boats passed on the second of May.",
         "“We had no plan,” said the mayor, “but we had shovels, and that turned out to be enough.”"]
SOUP = ["A soup for cold evenings", "This recipe came from a neighbour who cooked for a crew of twelve, so halve it unless you are feeding one.",
        "two onions, chopped", "a litre of stock", "three large potatoes", "Soften the onions slowly in butter, at least twenty minutes, before anything else goes in.", "Serve it with bread and do not reheat it more than once."]
CODE = ["Reading a file in blocks", "Opening a file and reading it whole is fine until the file no longer fits in memory.", "The usual answer is a loop that reads a fixed number of bytes and hands each block on.",
        "A block may end in the middle of a line, so keep what follows the last line feed for the next turn.", "That is all there is to it; the rest of this note measures how large a block should be."]
NEWS = ["Council votes to keep the night bus", "The city council decided on Tuesday to keep line 41 running through the night, at least until the end of next year.",
        "Eleven members voted in favour, six against, and two abstained after a debate of nearly three hours.", "Passengers had collected nine thousand signatures since January.", "The operator said it would publish a new timetable before the summer."]
GERMAN = ["Der Turm am alten Hafen", "Seit zwei Jahren steht der Turm leer, und noch immer weiß niemand, wem er eigentlich gehört.", "Die Stadt verhandelt mit den Erben, doch deren Zahl wächst von Monat zu Monat.",
          "Im Herbst soll ein Gutachten klären, ob das Dach den nächsten Winter übersteht.", "Bis dahin bleibt das Gelände gesperrt."]
FORUM = ["How do I get rust off a plane iron?", "I inherited a box of old planes and the irons are all covered in rust, some of it quite deep.", "I have tried vinegar overnight, which took the worst off but left the steel grey and rough.", "Is there a gentler way that keeps the makers' stamps readable?"]


def paragraphs(blocks, tag="p"):
    return "".join(f"<{tag}>{b}</{tag}>" for b in blocks)


PAGES = {
    # Anonymous class names, no semantic tags.
    "div soup": ("<html><body><div class='x1'><div class='x2'><a href='/'>Valley Post</a></div><div class='x3'><a href='/a'>World</a> <a href='/b'>Local</a> <a href='/c'>Weather</a> <a href='/d'>Letters</a></div></div>"
                 f"<div class='x7'><div class='x8'><h1>{RIVER[0]}</h1>" + "".join(f"<div class='x9'>{b}</div>" for b in RIVER[1:]) + "</div></div>"
                 "<div class='x12'><a href='/1'>Ten bridges to see</a><br><a href='/2'>Why we moved</a><br><a href='/3'>Subscribe for less</a></div><div class='x13'>© 2021 Valley Post. All rights reserved. <a href='/p'>Privacy</a></div></body></html>", RIVER),
    # Layout by nested tables.
    "tables": ("<html><body bgcolor=white><table width=760><tr><td colspan=3><font size=5>Grandmother's Kitchen</font></td></tr><tr><td width=120 valign=top><a href=1>Home</a><br><a href=2>Soups</a><br><a href=3>Cakes</a><br><a href=4>Guestbook</a></td>"
               f"<td valign=top><h2>{SOUP[0]}</h2><p>{SOUP[1]}<ul>" + "".join(f"<li>{b}" for b in SOUP[2:5]) + f"</ul><p>{SOUP[5]}<p>{SOUP[6]}</td><td width=150><a href=5>Buy our book</a><p><a href=6>Link to us</a></td></tr>"
               "<tr><td colspan=3 align=center><font size=1>Copyright 1999, all rights reserved. Best viewed at 800x600. <a href=7>Webmaster</a></font></td></tr></table></body></html>", SOUP),
    # Comments inside the article element.
    "comments within": (f"<body><header><a href=/>notes</a></header><article><h1>{CODE[0]}</h1>{paragraphs(CODE[1:])}<section id='responses'><h4>3 responses</h4><div class='response'><b>ada</b><p>Thanks, this saved my afternoon, I had been reading it whole for years.</p></div>"
                        "<div class='response'><b>linus</b><p>You forgot to close the file at the end.</p></div><form><textarea></textarea><button>Post reply</button></form></section></article><footer><p>Powered by coffee. <a href=/rss>RSS</a></p></footer></body>", CODE),
    # Utility-class markup with a cookie layer and share buttons.
    "utility classes": ("<body class='antialiased'><div class='fixed bottom-0 z-50 p-4' role='dialog'><p>We value your privacy. We and our partners store cookies on your device.</p><button>Accept all</button><button>Manage options</button></div>"
                        "<div class='flex justify-between px-6'><a class='font-bold' href='/'>The Courier</a><ul class='flex gap-4'><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li><li><a href='/o'>Opinion</a></li></ul></div>"
                        f"<div class='prose mx-auto'><h1 class='text-4xl'>{NEWS[0]}</h1><div class='flex gap-2'><a href='#'>Tweet</a><a href='#'>Email</a></div>" + "".join(f"<p class='mt-4 leading-7'>{b}</p>" for b in NEWS[1:]) + "</div>"
                        "<div class='grid grid-cols-3'><a href='/1'><h3>Storm closes two schools</h3></a><a href='/2'><h3>Library to open on Sundays</h3></a></div><div class='bg-gray-900 text-xs'><p>© The Courier. Terms of use. Contact us.</p></div></body>", NEWS),
    # Another language, advert between paragraphs.
    "advert between": (f"<html lang=de><body><nav><ul><li><a href=/>Start</a></li><li><a href=/p>Politik</a></li><li><a href=/k>Kultur</a></li></ul></nav><main><h1>{GERMAN[0]}</h1><p>{GERMAN[1]}</p><p>{GERMAN[2]}</p><div class='anzeige'><span>Anzeige</span><p>Jetzt vier Wochen kostenlos testen</p></div>"
                       f"<p>{GERMAN[3]}</p><p>{GERMAN[4]}</p></main><aside><h4>Meistgelesen</h4><ol><li><a href=1>Streit um den Markt</a></li><li><a href=2>Neue Brücke gesperrt</a></li></ol></aside><footer>Impressum · Datenschutz · © 2022</footer></body></html>", GERMAN),
    # A question page; replies of readers are comments.
    "question": (f"<body><div id='top'><a href='/'>Workshop board</a> <a href='/login'>Log in</a> <form action='/search'><input name=q></form></div><div id='question'><h1>{FORUM[0]}</h1><div class='body'>{paragraphs(FORUM[1:])}</div></div>"
                 "<div id='comments'><h2>2 comments</h2><div class='comment'><span>oldtimer</span><p>Evaporust, and patience.</p></div><div class='comment'><span>chips</span><p>Leave the stamps alone and wire wool the rest.</p></div></div><div id='foot'><a href='/about'>About</a> <a href='/rules'>Rules</a></div></body>", FORUM),
}


def scores(model=None):
    model = model or html_text.trained()
    out = {}
    for name, (page, want) in PAGES.items():
        got, true = Counter(html_text.extract_all(model, [page])[0].split()), Counter(" ".join(want).split())
        hit = sum((got & true).values())
        out[name] = (hit / max(1, sum(got.values())), hit / sum(true.values()))
    return out


def test_foreign_templates():
    got = scores()
    precision, recall = (sum(v[k] for v in got.values()) / len(got) for k in (0, 1))
    assert precision >= 0.93 and recall >= 0.88, got
    assert min(min(v) for v in got.values()) >= 0.6, got

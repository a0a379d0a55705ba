"""Forms that wrap a page or are never closed hold its text; forms of controls hold none."""

from collections import Counter

from blocklens.llm import htmltext

MAIN = " ".join(f"word{i} of the story" for i in range(30))
FORM = "<form id=f><input type='hidden' name=v><label>Name of visitor</label><input name=n><button>Send it</button><p>Please fill in</p></form>"


def text(page):
    return htmltext.extract(page, htmltext.weights_from(sum((htmltext.counts(e) for e in htmltext.EXAMPLES), Counter())))


def test_forms():
    assert text(f"<body><form action='x'><input type=hidden name=state><nav>menu</nav><div><p>{MAIN}</p></div><input name=q></form></body>") == MAIN
    assert text(f"<body><form action='x'><article><p>{MAIN}</p></article></form></body>") == MAIN
    assert text(f"<body><form><input name=q><p>{MAIN}</p><p>{MAIN}</p>") == f"{MAIN}\n{MAIN}"
    assert text(f"<body><p>{MAIN}</p>{FORM}</body>") == MAIN and text(f"<body>{FORM}</body>") == ""

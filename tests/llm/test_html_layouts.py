"""Pages whose main text stands in no named container come out whole, without what stands around it."""

import pytest

from tremor.llm import html_text

PARAGRAPHS = [
    "The council met on Tuesday evening to discuss the plans for the old harbour, which has stood empty since the ferry moved.",
    "Residents of the nearby streets asked for more trees, fewer cars and a place where children could play in the open.",
    "An engineer explained that the quay wall needs repair before anything can be built on it, and that this takes two years.",
    "Several speakers doubted the figures, as earlier estimates had turned out to be far too low in almost every case.",
    "A decision is expected in the spring, after the study of the ground has been finished and published for comment.",
]
EQUAL = [" ".join(["plain words of about the same length in each of these lines"] * 4 + [name]) for name in ("one", "two", "six", "ten", "nil")]
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul></nav>'
FOOT = '<footer><p>&copy; 2024 Example. <a href="/terms">Terms</a> <a href="/privacy">Privacy</a></p></footer>'
ALL = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
LAYOUTS = {
    "body": (f"<body>{ALL}</body>", PARAGRAPHS),
    "equal paragraphs under body": ("<body>" + "".join(f"<p>{p}</p>" for p in EQUAL) + "</body>", EQUAL),
    "nav, title, footer": (f"<body>{NAV}<h1>The harbour</h1>{ALL}{FOOT}</body>", ["The harbour", *PARAGRAPHS]),
    "plain div": (f"<body>{NAV}<div><h1>The harbour</h1>{ALL}</div>{FOOT}</body>", ["The harbour", *PARAGRAPHS]),
    "nested plain divs": (f"<body><div><div>{ALL}</div></div></body>", PARAGRAPHS),
    "row and column": (f'<body>{NAV}<div class="row"><div class="col-8">{"".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3])}</div></div>{FOOT}</body>', PARAGRAPHS[:3]),
    "plain section": (f"<body><section>{ALL}</section>{FOOT}</body>", PARAGRAPHS),
    "bare text": (f"<body>{PARAGRAPHS[0]}<br>{PARAGRAPHS[1]}</body>", PARAGRAPHS[:2]),
    "sources": (f'<body>{NAV}<article>{ALL}<h2>Sources</h2><ul><li><a href="/a">Harbour study of the city</a></li><li><a href="/b">Minutes of the meeting</a></li></ul></article>{FOOT}</body>', [*PARAGRAPHS, "Sources", "Harbour study of the city", "Minutes of the meeting"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_without_a_named_container(name):
    page, want = LAYOUTS[name]
    assert html_text.main_texts(html_text.trained(), [f"<html><head><title>t</title></head>{page}</html>"]) == [" ".join(want)]

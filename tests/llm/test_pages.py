"""Pages on which names, forms and articles mislead; and how long hostile ones take."""

import random
import time

import pytest

from glosstream.llm.html_extract import Node, _order, main_text, measure, parse, prune, score


def text(name):
    return f"{name} is a paragraph of the article, with commas, and enough words to count as prose, and it goes on for a while."


def p(*names):
    return "".join(f"<p>{text(n)}</p>" for n in names)


def lines(*names):
    return "\n".join(map(text, names))


READER = "<p>I liked this very much, thanks a lot, it was great to read, and I will come back, for sure, tomorrow, said the reader.</p>"
NOTICE = "<div class='notice'><p>This site uses cookies to make your visit better, by going on you agree, read more here and there.</p></div>"
PROMO = "<div class='promo'><p>Buy our new product today, it is the best, really, and so cheap, do it now, please.</p></div>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form id='aspnetForm'><article>{p('A', 'B')}</article></form></body>", lines("A", "B")),
        (f"<body><form><div>{p('A', 'B', 'C')}</div><input><button>Go</button></form></body>", lines("A", "B", "C")),
        ("<body><div><form><label>User</label><input><p>Please log in with your name.</p><button>Log in</button></form></div></body>", ""),
        (f"<article>{p('A')}<form><p>Your email address will not be published, fields with a star are required, all of them, and that is that.</p><label>Name</label><input></form></article>", lines("A")),
        (f"<article>{p('A')}<div id='comments'><ol><li class='comment'><article class='comment-body'>{READER * 3}</article></li></ol></div></article>", lines("A")),
        (f"<body><article>{p('A')}</article><div id='comments'><li class='comment'><article class='comment-body'>{READER * 3}</article></li></div></body>", lines("A")),
        (f"<body><article>{p('A')}</article><article class='comment'>{READER * 3}</article></body>", lines("A")),
        (f"<div class='post-with-comments'><article>{p('A', 'B')}</article></div>", lines("A", "B")),
        (f"<body><div id='content-comments-wrapper'><article>{p('A', 'B')}</article></div></body>", lines("A", "B")),
        (f"<article>{p('A', 'B')}{PROMO}{p('C')}{NOTICE}{p('D')}</article>", lines("A", "B", "C", "D")),
        (f"<article>{p('A')}<p class='related'>{text('B')}</p><p class='share'>{text('C')}</p><p class='share'>Share it!</p></article>", lines("A", "B", "C")),
        (f"<article>{p('A', 'B')}<section class='discussion'><div class='comment'>{READER}</div></section></article>", lines("A", "B")),
        (f"<article>{p('A', 'B')}<section class='discussion'><h2>Discussion</h2>{p('C')}</section></article>", lines("A", "B") + "\nDiscussion\n" + text("C")),
        (f"<article>{p('A')}<article class='part'>{p('B')}</article>{p('C')}</article>", lines("A", "B", "C")),
        (f"<body><div class='page sidebar-layout'>{p('A', 'B', 'C')}</div><div class='sidebar'><p>Short text, beside it.</p></div></body>", lines("A", "B", "C")),
    ],
)
def test_what_is_the_article(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("piece", ["<b>x</i>", "<td><b>x</div>", "<b><li>", "<p><b>", "<dd><i>", "<div class=comment>", "</p>", "<ul><li><td>", "<header><b>"])
def test_hostile_markup_is_read_in_linear_time(piece):
    took = []
    for size in (100_000, 800_000):
        page = piece * (size // len(piece))
        began = time.perf_counter()
        main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.05)


def plain_scores(node):
    """Points by the words of the method: each paragraph passes its points on to its five ancestors."""
    found = {}

    def visit(n):
        kids = [k for k in n.kids if isinstance(k, Node)]
        for k in kids:
            visit(k)
        if n.tag == "p" and n.chars:
            points = (1 + whole(n).count(",") + min(len(whole(n)) / 100, 30)) * (1 - n.linked / n.chars)
            above, share = n.parent, [1, 2, 6, 9, 12]
            for s in share:
                if above is None:
                    break
                found[above] = found.get(above, 0) + points / s
                above = above.parent

    def whole(n):
        return "".join(k if isinstance(k, str) else whole(k) for k in n.kids)

    visit(node)
    return {n: v * (1 - n.linked / max(1, n.chars)) for n, v in found.items()}


@pytest.mark.parametrize("seed", range(5))
def test_scores_against_a_plain_scorer(seed):
    rng = random.Random(seed)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join(rng.choice(["one", "two,", "three", "four,"]) for _ in range(rng.randint(1, 60)))
            return f"<p>{words}{'<a href=x>link text</a>' * rng.randint(0, 2)}</p>"
        return f"<div>{''.join(some(depth - 1) for _ in range(rng.randint(1, 4)))}</div>"

    root = parse(f"<body>{some(5)}</body>")
    prune(root)
    score(root)
    measure(_order(root))
    want = plain_scores(root)
    got = {n: n.score for n in _order(root) if n.score}
    assert got.keys() == {n for n, v in want.items() if v} and all(abs(got[n] - want[n]) < 1e-9 for n in got)

import random

from heddle.llm import page_body

SCHEMA = "rec_id bigint, url string, title string, content string, units string, page string"
NAMES = ["Alda", "Brin", "Corv", "Dest", "Elmo", "Fara", "Gwin", "Hest", "Ivor", "Jura", "Kest", "Lira"]


def page(k: int, host: str = "https://www.site.example"):
    """A page and the numbers of its lines outside the main body."""
    rng = random.Random(k)
    name = lambda: rng.choice(NAMES).lower().capitalize() + rng.choice(NAMES).lower() + rng.choice(NAMES).lower()
    me = name()
    title = f"How {me} changed the {rng.choice(['hem', 'seam', 'cut'])} of {name()}"
    lines, out = [], []

    def add(text, outside):
        lines.append(text)
        if outside and text.strip():
            out.append(len(lines))

    for x in ["• Sign in", "• Search", "• Archive"]:
        add(x, True)
    add("Home / Shop / " + " / ".join(rng.sample(["Beauty", "Runway", "Trends", "Archive"], 2)), True)
    add("We and our 612 partners keep files on your device.".replace("612", str(rng.randrange(999))), True)
    add(title, False)
    add("", False)
    add(f"{name()} spoke to {me} about {name()} for an hour. It was late.", False)
    if k % 3 == 0:
        add("Enough.", False)
    if k % 2 == 0:
        add("Advertisement", True)
    add(f"Then {name()} left {name()} with {me}, and nobody knew why.", False)
    add(f"- {name()}, silk", False)
    add("Most read", True)
    for n in range(3):
        add([f"{n + 1}. Why {name()} chose {name()}", f"The soft cut of {name()} · {n + 3} min", f"Inside {name()}: {name()} never wanted {name()} to stay."][(n + k) % 3], True)
    add(f"© {2000 + k % 20} Site Media. All rights reserved.", True)
    slug = title.lower().replace(" ", "-")
    return (k, f"{host}/story/{slug}-s{k % 97:x}", title if k % 4 else None, "\n".join(lines), "clash", "clash"), {(k, n) for n in out}


def test_lines_outside_body(spark):
    made = [page(k) for k in range(60)]
    rows = [r for r, _ in made] + [made[0][0], (900, None, None, None, "", ""), (901, "https://www.site.example/x", None, "", "", ""), (902, None, None, " \n\t\n", "", ""), (None, "https://www.site.example/y", "t", "• Search", "", "")]
    wanted = set().union(*(w for _, w in made))
    store = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = [(r.rec_id, r.line_no) for r in page_body.lines_outside_body(store).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_a_page_alone_is_body(spark):
    one = spark.createDataFrame([page(1)[0]], SCHEMA)
    # only what stands before the headline can be told
    assert {r.line_no for r in page_body.lines_outside_body(one).collect()} == {1, 2, 3, 4, 5}
    assert page_body.lines_outside_body(one.limit(0)).count() == 0


def test_bodies(spark):
    made = [page(k) for k in range(30)]
    store = spark.createDataFrame([r for r, _ in made] + [(900, None, None, None, "", "")], SCHEMA)
    cut = set().union(*(w for _, w in made))
    for r in page_body.main_body(store).collect():
        if r.content is None:
            assert r.body is None and r.lines_cut == 0
        else:
            assert r.body.split("\n") == [x for n, x in enumerate(r.content.split("\n"), 1) if (r.rec_id, n) not in cut]


def test_long_and_odd_content():
    url, title, text = "https://h.example/a-b", "A b", "word " * 300_000 + "\n|||\n x\n" + "a / b / c"
    _, _, numbers, flags, phrases, symbols, sizes = page_body.read_page(url, title, text)
    assert numbers == [1, 2, 3, 4] and sum(phrases) == len(symbols) == len(sizes) and phrases[3] == 3 and sum(sizes) == 300_005


NOTICE = "We and our 14 partners keep small files on your device, so that we know what you have read and what to show next, and you may refuse each of them in the centre for settings, where a list of all partners stands with the purposes that they have named to us, the time for which they keep what they learn, and a way to write to them; whoever goes on reading without a choice agrees to the files that the site cannot do without, and to no others than these, until the choice is made or the visit ends."


def prose(k: int) -> str:
    rng = random.Random(k)
    return " ".join(rng.choice(NAMES).lower() + rng.choice(NAMES).lower() + rng.choice(NAMES).lower() for _ in range(40)) + "."


def test_strings_within_lines_are_cut(spark):
    """Pages of one line each: a notice before, after or around the text, with other numbers on every page."""
    shapes = [lambda n, x: f"{n} {x} {n}", lambda n, x: f"{n} {x}", lambda n, x: f"{x} {n}"]
    for shape in shapes:
        rows = [(k, f"https://h.example/p{k}", None, shape(NOTICE.replace("14", str(k)), prose(k).capitalize()), "", "") for k in range(60)]
        out = page_body.main_body(spark.createDataFrame(rows, SCHEMA)).collect()
        for r in out:
            assert r.lines_cut == 0 and r.strings_cut > 0
            assert "partners" not in r.body and "cannot do without" not in r.body and "visit ends" not in r.body
            assert " ".join(prose(r.rec_id).lower().split()[5:35]) in r.body.lower()


def test_rare_notice_of_a_large_host_is_cut(spark):
    """Three pages of many suffice, however many pages the host has."""
    rows = [(k, f"https://h.example/p{k}", None, f"{prose(k)}\n{NOTICE if k < 3 else prose(5000 + k)}\n{prose(9000 + k)}", "", "") for k in range(3000)]
    assert {(r.rec_id, r.line_no) for r in page_body.lines_outside_body(spark.createDataFrame(rows, SCHEMA)).collect()} == {(0, 2), (1, 2), (2, 2)}


def test_one_id_with_two_contents(spark):
    rows = [(k, f"https://h.example/p{k}", None, f"{prose(k)}\n{NOTICE}", "", "") for k in range(4)] + [(0, "https://h.example/p9", None, f"{NOTICE}\n{prose(77)}", "", "")]
    got = {(r.rec_id, r.line_no) for r in page_body.lines_outside_body(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(0, 2), (1, 2), (2, 2), (3, 2), (0, 1)}

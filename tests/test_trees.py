"""Stored runs, hyperlinks, outlines and nested cells against plain walks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.operators import outlines, runs, trees


# --------------------------------------------------------------------------- runs


def plain_runs(text, ends, styles):
    units = (text or "").encode("utf-16-le", "surrogatepass")
    units = [units[i : i + 2] for i in range(0, len(units), 2)]
    ends = list(ends or [])
    if units and units[0] == b"\x0b\0" and ends and ends[0] == 1 and len(styles) - len(ends) in (0, 1):
        styles = styles[:-1] if len(styles) > len(ends) else styles
        units, ends = units[1:], [None if e is None else e - 1 for e in ends[1:]]
    ends = [len(units) if e is None or e < 0 else e for e in ends]
    if not styles:
        return [(0, 0, len(units), "".join(said(units)), None)]
    out, start = [], 0
    for i, s in enumerate(styles):
        end = max(start, min(ends[i], len(units)) if i < len(ends) else len(units))
        out.append((i, start, end, said(units[start:end]), s))
        start = end
    return out


def said(units):
    """Half a pair stands for itself in Python's strings; it is U+FFFD in ours."""
    return "".join("�" if 0xD800 <= ord(c) < 0xE000 else c for c in b"".join(units).decode("utf-16-le", "surrogatepass"))


def test_runs(spark):
    r = random.Random(3)
    paragraphs, styles, want = [], [], Counter()
    for i in range(150):
        text = r.choice(["", "\x0b"]) + "".join(r.choice("ab é𝒳😀\n") for _ in range(r.randrange(8))) if i else None
        ends = [r.choice([1, r.randrange(12), r.randrange(12), 99, None]) for _ in range(r.randrange(5))] if i % 10 else None
        if ends and r.random() < 0.5:
            ends[0] = 1
        own = [f"s{k}" for k in range(r.randrange(5))]
        paragraphs.append((i, text, ends, "x"))
        styles += [(i, k * 2, s) for k, s in enumerate(own)]
        want.update((i, *x) for x in plain_runs(text, ends, own))
    r.shuffle(styles)
    p = spark.createDataFrame(paragraphs, "e long, text string, ends array<int>, run string").repartition(3)
    s = spark.createDataFrame([*styles, (999, 0, "lost")], "e long, pos int, style string").repartition(3)
    got = Counter((x["e"], x["run"], x["start"], x["end"], x["text"], x["style"]) for x in runs.split_runs(p, s, "e", "pos").collect())
    assert got == want
    assert runs.split_runs(p.limit(0), s, "e", "pos").count() == 0


def plain_links(rows):
    out, pending, hidden, open_ = [], "", "", False
    for pos, text, is_hidden, link, kind in rows:
        text = text or ""
        if kind != "text":
            out.append((pos, 0, text, ""))
            continue
        if is_hidden:
            hidden += text
            continue
        if runs.MARKER in hidden:
            pending, open_ = hidden.rsplit(runs.MARKER, 1)[1].split('"')[0], True
        hidden, part = "", 0
        while True:
            at = text.find(runs.MARKER)
            end = text.find('"', at + len(runs.MARKER)) if at >= 0 else -1
            if end < 0:
                break
            out.append((pos, part, text[:at], pending if open_ else ""))
            pending, open_, text, part = text[at + len(runs.MARKER) : end], True, text[end + 1 :], part + 1
        out.append((pos, part, text, pending if link and open_ else ""))
        open_ = open_ and bool(link)
    return [x for x in out if x[2] or rows[x[0]][4] != "text"]


def test_hyperlinks(spark):
    r = random.Random(4)
    pieces = ["a", "", None, f'{runs.MARKER}http://x"', f'b{runs.MARKER}y"c{runs.MARKER}z"', f"{runs.MARKER}open", "﷟HYPER", 'LINK "w', '"', f'{runs.MARKER}"d', "(.*)\n"]
    rows, want = [], Counter()
    for e in range(120):
        mine = [(k, r.choice(pieces), r.random() < 0.4, r.choice([True, True, False, None]), "math" if r.random() < 0.1 else "text") for k in range(r.randrange(9))]
        rows += [(e, *m) for m in mine]
        want.update((e, *x) for x in plain_links(mine))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "e long, pos int, text string, hidden boolean, hyperlink boolean, kind string").withColumn("part_of", F.lit(1))
    found = runs.hyperlinks(df, "e", "pos")
    assert Counter((x["e"], x["pos"], x["part"], x["text"], x["href"]) for x in found.collect()) == want
    assert found.columns == ["e", "pos", "text", "hyperlink", "kind", "part_of", "part", "href"]
    assert runs.hyperlinks(df.limit(0), "e", "pos").count() == 0


# --------------------------------------------------------------------------- outlines


def plain_outline(refs, deepest, budget):
    """{(id, parent, pos): (root, place, depth, size, above, level, fault)} by a walk."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    first = {}
    for r in sorted(refs, key=key):
        first.setdefault(r[0], r)
    under = {}
    for r in sorted(refs, key=lambda r: (r[2], r[0])):
        under.setdefault(r[1], []).append(r)
    out = {}
    for root in [r for r in refs if r[1] is None]:
        place, spent = 0, 0
        stack = [(root, 0, None, 0)]
        order = []
        while stack:
            r, depth, above, level = stack.pop()
            fault = None
            if depth and depth <= deepest:
                spent += 1
            if first[r[0]] is not r:
                fault = "shared"
            elif depth > deepest:
                fault = "deep"
            elif depth and spent > budget:
                fault = "budget"
            elif depth and r[3] is None:
                fault = "missing"
            order.append((r, depth))
            out[r[:3]] = [root[0], place, depth, None, above, level, fault]
            place += 1
            if first[r[0]] is r and r[3] is not None:
                shows = r[3] == "element"
                stack += [(c, depth + 1, r[0] if shows else above, level + shows) for c in reversed(under.get(r[0], []))]
        for i, (r, depth) in enumerate(order):
            n = 1
            while i + n < len(order) and order[i + n][1] > depth:
                n += 1
            out[r[:3]][3] = n
    for r in refs:
        if r[:3] not in out:
            seen, at = set(), r[1]
            while at in first and first[at][3] is not None and at not in seen:
                seen.add(at)
                at = first[at][1]
            out[r[:3]] = [None, None, None, None, None, None, "cycle" if at in seen else "loose"]
    return {k: tuple(v) for k, v in out.items()}


def outlined(df, *how):
    t = trees.outline(df, "kind", *how)
    return {(r["id"], r["parent"], r["pos"]): (r["root"], r["place"], r["depth"], r["size"], r["above"], r["level"] if r["root"] is not None else None, r["fault"]) for r in t.collect()}


def test_outline(spark):
    r = random.Random(6)
    refs = [(i, None, 0, "outline") for i in range(3)]
    for i in range(3, 160):
        parent = r.choice([r.randrange(i), i - 1, 500 + i % 3, i + 1 if i % 40 == 10 else i - 1, i - 1])
        refs.append((i, parent, r.randrange(4), r.choice(["element", "group", "group", None] if i > 20 else ["element", "group"])))
    refs += [(r.randrange(10, 100), r.randrange(150), 9 + k, "element") for k in range(6)]
    kinds = {}
    refs = [(i, p, k, kinds.setdefault(i, kind)) for i, p, k, kind in refs]
    df = spark.createDataFrame(refs, "id long, parent long, pos long, kind string").repartition(3)
    for how in ((64, 10**6), (12, 40)):
        assert outlined(df, *how) == plain_outline(refs, *how)
    assert trees.outline(df.limit(0)).count() == 0


def test_budget_of_a_large_page(spark):
    """The first 4,000 of 10,000 references, depth first, exactly."""
    n = 10_000
    refs = [(0, None, 0, "outline")] + [(i, (i - 1) // 2 if i % 5 else max(0, i - 1 - i % 7), i % 3, "group" if i % 4 == 0 else "element") for i in range(1, n)]
    df = spark.createDataFrame(refs, "id long, parent long, pos long, kind string").repartition(4)
    got = outlined(df, 64, 4000)
    assert got == plain_outline(refs, 64, 4000)
    assert Counter(v[6] for v in got.values())["budget"] == sum(0 < v[2] <= 64 for v in got.values()) - 4000


# --------------------------------------------------------------------------- cells


def plain_cell(id_, under, of):
    return "<br>".join(line for c in under.get(id_, []) for line in plain_lines(c, under, of)).replace("\n", " ")


def plain_lines(id_, under, of):
    prefix, out = of[id_][1], []
    children = [c for c in under.get(id_, []) if of[c][2] == "element"]
    for c in (c for c in under.get(id_, []) if of[c][2] != "element"):
        s = of[c][0]
        if of[c][2] == "table":
            s = ""
            for row in under.get(c, []):
                s += ("<br>" if s else "") + " / ".join(plain_cell(x, under, of) for x in under.get(row, []))
        if s.strip(" \t\r\n\v\f"):
            out.append(prefix + s)
        prefix = ""
    below = "<br>".join(line for c in children for line in plain_lines(c, under, of)).replace("\n", " ")
    return out + ([below] if below else [])


@pytest.mark.parametrize("seed", range(3))
def test_cells(spark, seed):
    r = random.Random(seed)
    nodes, count = [], [0]

    def add(parent, pos, kind, depth):
        count[0] += 1
        id_ = count[0]
        nodes.append((id_, parent, pos, kind, r.choice(["", " ", "a", "b\nc", None]) if kind == "leaf" else None, r.choice(["• ", "", None]) if kind == "element" else None))
        holds = {"cell": ["element"], "element": ["leaf", "leaf", "table", "element"], "table": ["row"], "row": ["cell"], "leaf": []}[kind]
        for k in range(r.randrange(4) if depth < 9 and holds else 0):
            add(id_, k, r.choice(holds), depth + 1)

    for _ in range(6):
        add(None, 0, "cell", 0)
    nodes.append((9999, 9998, 0, "cell", None, None))
    under = {}
    for n in nodes:
        under.setdefault(n[1], []).append(n[0])
    of = {n[0]: (n[4] or "", n[5] or "", n[3]) for n in nodes}
    df = spark.createDataFrame(nodes, "id long, parent long, pos int, kind string, text string, prefix string").repartition(3)
    got = {x["id"]: x["text"] for x in trees.cell_texts(df).collect()}
    assert got == {n[0]: plain_cell(n[0], under, of) for n in nodes if n[3] == "cell" and n[0] != 9999}
    assert trees.cell_texts(df.limit(0)).count() == 0


# --------------------------------------------------------------------------- markup


def plain_markup(els, note):
    def kind(e):
        box = e["done"] is not None
        if e["list"] is None and e["code"]:
            return "code"
        if box:
            return "none" if note else "task"
        return e["list"] or "none"

    def esc(s, quotes=False):
        s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return s.replace('"', "&quot;").replace("'", "&#39;") if quotes else s

    def item(e, k):
        body = e["body"] or ""
        if note:
            todo = "" if e["done"] is None else f'<en-todo checked="{str(e["done"]).lower()}"/>'
            return f"<div>{todo}{body or ('' if todo else '<br/>')}</div>"
        if k == "none":
            return f"<p>{body}</p>"
        if k == "task":
            return f'<input type="checkbox" disabled{" checked" if e["done"] else ""}>{body}'
        glyph = e["glyph"] or ""
        return (f'<span class="bullet">{esc(glyph, True)}</span>' if k == "bullet" and glyph not in ("", "•", "◦", "o", "▪", "■") else "") + body

    def opened(e, k):
        if k == "ordered":
            kinds = {1: "I", 2: "i", 3: "A", 4: "a"}
            n, r = e["number_style"], e["restart"]
            start = r is not None and (r > 1 if note else r != 1)
            return "<ol" + (f' type="{kinds[n]}"' if n in kinds else "") + (f' start="{r}"' if start else "") + ">"
        if note:
            return "<ul>"
        if k == "task":
            return '<ul class="tasks">'
        g = e["glyph"] or ""
        style = {"◦": "circle", "o": "circle", "▪": "square", "■": "square"}.get(g)
        return f'<ul style="list-style-type:{style}">' if style else "<ul>" if g in ("", "•") else '<ul class="bullets-custom">'

    def code(e):
        if not note:
            return esc(e["text"] or "") + "\n"
        out = ""
        for line in (e["text"] or "").split("\n"):
            rest = line.lstrip(" \t")
            lead = line[: len(line) - len(rest)].replace("\t", "&#160;" * 4).replace(" ", "&#160;")
            out += f"<div>{lead + esc(rest, True) or '<br/>'}</div>"
        return out

    s, i = "", 0
    while i < len(els):
        e, k = els[i], kind(els[i])
        if k == "code":
            s += f'<div style="{outlines.NOTE_CODE}">' if note else '<pre class="code"><code>'
            while i < len(els) and kind(els[i]) == "code":
                s, i = s + code(els[i]), i + 1
            s += "</div>" if note else "</code></pre>"
        elif k == "none":
            s += item(e, k)
            if e["children"]:
                s += ('<div style="padding-left: 40px;">' if note else '<div class="indent">') + plain_markup(e["children"], note) + "</div>"
            i += 1
        else:
            s += opened(e, k)
            while i < len(els) and kind(els[i]) == k and (note or k != "bullet" or (els[i]["glyph"] or "") == (e["glyph"] or "")):
                s += f"<li>{item(els[i], k)}{plain_markup(els[i]['children'], note)}</li>"
                i += 1
            s += "</ol>" if k == "ordered" else "</ul>"
    return s


def test_markup(spark):
    r = random.Random(9)
    rows, pages = [], {}

    def grow(page, above, depth, count):
        out = []
        for _ in range(r.randrange(4) if depth < 6 else 0):
            count[0] += 1
            e = {
                "page": page, "place": count[0], "size": None, "depth": depth, "above": above, "list": r.choice([None, None, "ordered", "bullet", "bullet"]), "done": r.choice([None, None, None, True, False]),
                "code": r.choice([None, False, True]), "glyph": r.choice([None, "", "•", "o", "★", "<"]), "number_style": r.choice([None, 0, 1, 3, 9]), "restart": r.choice([None, 0, 1, 5]), "text": r.choice([None, "", "a<'\n\n \tb  "]), "body": r.choice([None, "", "<b>x</b>"]), "kind": 5,
            }
            rows.append(e)
            e["children"] = grow(page, e["place"], depth + 1, count)
            e["size"] = count[0] - e["place"] + 1
            out.append(e)
        return out

    for page in (*range(25), None):
        pages[page] = grow(page, None, 1, [0])
    r.shuffle(rows)
    fields = "page long, place long, size long, depth long, above long, list string, done boolean, code boolean, glyph string, number_style int, restart int, text string, body string, kind int"
    df = spark.createDataFrame([tuple(e[f.split()[0]] for f in fields.split(", ")) for e in rows], fields).repartition(3)
    for make, note in ((outlines.html_outline, False), (outlines.note_outline, True)):
        assert {x["page"]: x["text"] for x in make(df).collect()} == {p: plain_markup(els, note) for p, els in pages.items() if els}
        assert make(df.limit(0)).count() == 0


# --------------------------------------------------------------------------- Markdown


def trimmed(s):
    return s.strip(" \t\r\n\v\f")


def line_start(s):
    import re

    if re.fullmatch(r"(?s)(?:#{1,6}|[-+])(?: .*)?|-+|=+", s):
        return "\\" + s
    return re.sub(r"^([0-9]{1,9})([.)])(?= |\Z)", r"\1\\\2", s)


class PlainMarkdown:
    """A walk over the tree, a block at a time."""

    def __init__(self, vault):
        self.vault, self.out, self.after_item, self.tags = vault, "", False, []

    def block(self, s, indent, item):
        if trimmed(s):
            self.out += ("" if item and self.after_item else "\n") + indent + s + "\n"
            self.after_item = item

    def paragraph(self, e, cont, in_list):
        lines, style = list(e["lines"]), e["style"] or ""
        prefix, suffix = e["prefix"] or "", "".join(f" #{s}" for s in e["slugs"] or []) if self.vault else ""
        level = 1 if style == "PageTitle" else int(style[1]) if len(style) == 2 and style[0] == "h" and style[1] in "123456" else 0
        if level:
            said = ""
            for s in lines:
                said += (" " if said else "") + s
            said = trimmed(said)
            if not said:
                return ""
            out = f"{prefix}**{said}**{suffix}" if in_list else f"{'#' * min(6, level + 1)} {prefix}{said}{suffix}"
        else:
            lines = [line_start(s) for s in lines]
            if lines:
                lines[0] = prefix + lines[0]
            quote = "> " if style == "blockquote" else ""
            out = quote + (("  \n" if self.vault else "\\\n") + cont + quote).join(lines)
            if style == "cite" and trimmed(out) and "\n" not in out:
                out = f"*{out}*"
            out += suffix if trimmed(out) else ""
        if trimmed(out) and self.vault:
            self.tags += [s for s in e["slugs"] or [] if s not in self.tags]
        return out

    def elements(self, els, indent):
        i, number = 0, 0
        while i < len(els):
            e = els[i]
            if e["code"] and e["list"] is None:
                code = ""
                while i < len(els) and els[i]["code"] and els[i]["list"] is None:
                    code, i = code + "".join(f"{indent}{s}\n" for s in (els[i]["text"] or "").split("\n")), i + 1
                fence = "~~~" if "```" in code else "```"
                self.block(f"{fence}\n{code}{indent}{fence}", indent, False)
                number = 0
                continue
            ordered = e["list"] == "ordered"
            if ordered:
                number = (e["restart"] if e["restart"] is not None else 1) if not i or els[i - 1]["list"] != "ordered" else number + 1
            if e["list"] is None and e["done"] is None:
                if e["lines"] is not None:
                    self.block(self.paragraph(e, indent, bool(indent)), indent, False)
                self.elements(e["children"], indent)
            else:
                marker = (f"{max(1, number)}." if ordered else "-") + ("" if e["done"] is None else " [x]" if e["done"] else " [ ]")
                cont = indent + ("  " if e["done"] is not None and not ordered else " " * (len(marker) + 1))
                body = self.paragraph(e, cont, True) if e["lines"] is not None else ""
                self.block(marker + (" " + body if body else ""), indent, True)
                self.elements(e["children"], cont)
                self.after_item = True
            i += 1


@pytest.mark.parametrize("vault", [False, True])
def test_markdown(spark, vault):
    r = random.Random(11)
    rows, pages = [], {}

    def grow(page, above, depth, count):
        out = []
        for _ in range(r.randrange(4) if depth < 6 else 0):
            count[0] += 1
            e = {
                "page": page, "place": count[0], "size": None, "depth": depth, "above": above, "list": r.choice([None, None, "ordered", "ordered", "bullet"]), "done": r.choice([None, None, None, True, False]),
                "code": r.choice([None, False, False, True]), "restart": r.choice([None, None, 2, 5]), "text": r.choice([None, "", "a\n  b", "```"]), "style": r.choice([None, "", "h2", "h6", "PageTitle", "blockquote", "cite", "p"]),
                "lines": r.choice([None, [], [""], ["x"], [" y ", "# z"], ["", "- q", "12. r"]]), "prefix": r.choice([None, "", "★ "]), "slugs": r.choice([None, [], ["a"], ["b", "c"]]),
            }
            rows.append(e)
            e["children"] = grow(page, e["place"], depth + 1, count)
            e["size"] = count[0] - e["place"] + 1
            out.append(e)
        return out

    for page in (*range(30), None):
        pages[page] = grow(page, None, 1, [0])
    r.shuffle(rows)
    fields = "page long, place long, size long, depth long, above long, list string, done boolean, code boolean, restart int, text string, style string, lines array<string>, prefix string, slugs array<string>"
    df = spark.createDataFrame([tuple(e[f.split()[0]] for f in fields.split(", ")) for e in rows], fields).repartition(3)
    want = {}
    for page, els in pages.items():
        plain = PlainMarkdown(vault)
        plain.elements(els, "")
        if els:
            want[page] = (plain.out, plain.tags)
    got = {x["page"]: (x["text"], x["tags"]) for x in outlines.markdown_outline(df, vault).collect()}
    assert got.keys() == want.keys()
    assert [p for p in want if got[p] != want[p]] == []
    assert outlines.markdown_outline(df.limit(0), vault).count() == 0

"""Quality rules, licenses, HTML, secrets and the pipeline."""

import random
import re

import pyarrow as pa
import pytest
from helpers import components, exact_groups, prose, table, texts, words
from pyspark.sql import functions as F

from keystrata.llm import htmltext, licenses, packing, quality, secrets


def covered_words(ws, k):
    cover, seen = [False] * len(ws), {}
    for i in range(len(ws) - k + 1):
        seen.setdefault(tuple(ws[i : i + k]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                cover[i : i + k] = [True] * k
    return sum(cover)


def longest_repeat(ws):
    k = 0
    while covered_words(ws, k + 1):
        k += 1
    return k


def verdict(text, limits=quality.Limits()):
    ws = words(text)
    repeat = covered_words(ws, limits.window)
    failed = len(ws) < limits.words or 100 * repeat > limits.repeat_percent * len(ws)
    fine = 100 * covered_words(ws, limits.least) <= limits.covered_percent * len(ws) and longest_repeat(ws) <= limits.longest
    return failed, not failed and fine, repeat


def quality_texts():
    rng = random.Random(4)
    return [t for t in texts() if len(t or "") < 4000] + [" ".join(rng.choices("abc", k=rng.randrange(60))) for _ in range(30)] + [
        "spam " * 300, f"{prose(rng, 90)} {prose(random.Random(5), 70)} {prose(rng, 300)} {prose(random.Random(5), 70)}", "a#b\n$\n\n a#b \na#b\n<|>"
    ]


def test_quality(spark):
    rows = list(enumerate(quality_texts()))
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, rows, extra=False)).collect()}
    for i, t in rows:
        r, ws = got[i], words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.base_failed, r.kept, r.n_repeat_words) == verdict(t)
        assert (r.n_words, r.word_chars) == (len(ws), sum(map(len, ws)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.longest_repeat == longest_repeat(ws) and r.n_covered == covered_words(ws, 5)
    assert not got[len(rows) - 2].kept and not got[len(rows) - 2].base_failed  # a long repeat alone


def test_quality_keeps_columns(spark):
    docs = table(spark, [(1, prose(random.Random(1), 50)), (None, None), (2, "x " * 50)])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [(r.doc_id, r.kept) for r in kept.collect()] == [(1, "own")]
    assert quality.quality_rules(docs, keep_columns=True).count() == 3
    assert quality.quality_rules(table(spark, [])).count() == 0 and quality.keep_good(table(spark, [])).count() == 0


def test_alignment_is_a_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = (rng.choices("abcdefghijkl", k=rng.randrange(25)) for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    ordered = [str(i) for i in range(40)]
    assert licenses.align([*"xy", *ordered, "z"], ordered) == [(i + 2, i) for i in range(40)]


def test_licenses(spark):
    rng = random.Random(1)
    noise = prose(rng, 3000)
    mit = licenses.TEMPLATES["MIT"].replace("sublicense", "license").upper()
    rows = [
        (0, f"{noise}\nLicensed under the Apache License, Version 2.0.\n{noise}"), (1, noise), (2, None), (3, f"(c) me. {mit} {noise}"),
        (4, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."),
        (5, "the license of this work is under version 2.0 of public general gnu apache"), (6, "Licensed under CC BY 4.0."),
    ]
    got = {r.doc_id: (r.licenses, r.license, r.coverage) for r in licenses.license_scan(table(spark, rows)).collect()}
    assert got[0] == (["Apache-2.0-notice"], "Apache-2.0-notice", 1.0) and got[1] == got[2] == ([], None, 0.0)
    assert got[3][1] == "MIT" and 0.95 < got[3][2] < 1
    assert got[4][0] == ["GPL-3.0-notice", "MIT-notice"] and got[5][0] == [] and got[6][0] == ["CC-BY-4.0-notice"]
    assert licenses.license_scan(table(spark, [])).count() == 0


GNU_HEADER = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the {1} as published by the Free"
    " Software Foundation; either version {2} of the License, or (at your option) any later version.\n\nThis {0} is distributed"
    " in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
    " FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details."
)
BSD_CLAUSES = (
    "Copyright (c) 2009 The Go Authors. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without"
    " modification, are permitted provided that the following conditions are met:\n\n * Redistributions of source code must retain"
    " the above copyright notice, this list of conditions and the following disclaimer.\n * Redistributions in binary form must"
    " reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
    " other materials provided with the distribution.\n"
)
ADVERTISING = (
    " * All advertising materials mentioning features or use of this software must display the following acknowledgement: This"
    " product includes software developed by the organization.\n"
)
NAMES = (
    " * Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission.\n"
)
MPL_1 = (
    'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file'
    " except in compliance with the License. You may obtain a copy of the License at\nhttp://www.mozilla.org/MPL/\n\nSoftware"
    ' distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied.'
    " See the License for the specific language governing rights and limitations under the License."
)
MPL_2 = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
    " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
)


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("All rights reserved.", "all-rights-reserved-notice"),
        (licenses.TEMPLATES["all-rights-reserved"], "all-rights-reserved"),
        (GNU_HEADER.format("program", "GNU General Public License", "2"), "GPL-2.0"),
        (GNU_HEADER.format("program", "GNU General Public License", "3"), "GPL-3.0"),
        (GNU_HEADER.format("library", "GNU Library General Public License", "2"), "LGPL-2.0"),
        (GNU_HEADER.format("library", "GNU Lesser General Public License", "2.1"), "LGPL-2.1"),
        (GNU_HEADER.format("program", "GNU Lesser General Public License", "2.1"), "LGPL-2.1"),
        (GNU_HEADER.format("library", "GNU Lesser General Public License", "3"), "LGPL-3.0"),
        (GNU_HEADER.format("program", "GNU Affero General Public License", "3"), "AGPL-3.0"),
        (BSD_CLAUSES, "BSD-2-Clause"),
        (BSD_CLAUSES + NAMES.format("Google Inc."), "BSD-3-Clause"),
        (BSD_CLAUSES + NAMES.format("the copyright holder").replace("prior ", ""), "BSD-3-Clause"),
        (BSD_CLAUSES + ADVERTISING + NAMES.format("the organization"), "BSD-4-Clause"),
        (MPL_1, "MPL-1.1"),
        (MPL_2, "MPL-2.0"),
        ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1-notice"),
    ],
)
def test_license_siblings(text, name):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    found = dict(scanner.matches(f"{prose(random.Random(2), 50)}\n{text}\n{prose(random.Random(3), 50)}"))
    assert set(found) - {name} <= ({"all-rights-reserved-notice"} if text.startswith("Copyright") else set())
    assert found[name] > 0.95


def test_reserved_rights_do_not_hide_a_license(spark):
    text = BSD_CLAUSES.replace("distribution.", "package.")
    row = licenses.license_scan(table(spark, [(1, text)])).first()
    assert row.licenses == ["BSD-2-Clause", "all-rights-reserved-notice"] and row.license == "BSD-2-Clause" and row.coverage < 1


SENTENCE = "This is a long enough sentence of the article that goes on for a while number {}."
LAYOUTS = [
    "<html><body><nav><a href=/a>Menu</a></nav><article><h1>Head</h1>{}</article><footer>Foot</footer></body></html>",
    "<body><div id='top-menu'><ul><li><a>x</a><li><a>y</a></ul></div><div class='main post-17'><h2>Head</h2>{}<div class='share'>Share!</div></div>"
    "<div class=sidebar><p>Sidebar text that is rather long, too, and about other things altogether.</p></div>"
    "<div id=comments><p>I like this article very much, thank you for writing such a long text about it.</p></div>",
    "<main><header><p>By someone</p></header><section class='text'><h1>Head</h1>{}</section></main><aside>More</aside><form>Name <input></form>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_main_text(layout):
    body = f"<p>{SENTENCE.format(1)} &amp; &lt;b&gt; &#233;&nbsp;x<br>\n <b>bold</b><script>var a = '<p>no</p>';</script><p>{SENTENCE.format(2)}<!-- no --><style>p{{}}</style>"
    page = layout.format(body)
    text = htmltext.extract(page, htmltext.vote(page))
    want = ["Head", f"{SENTENCE.format(1)} & <b> é x bold", SENTENCE.format(2)]
    assert text.split("\n\n")[-3:] == want and "Menu" not in text and "like" not in text and "Share" not in text


ARTICLE = f"<article><p>{SENTENCE.format(1)}</p><p>{SENTENCE.format(2)}</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<!DOCTYPE html><html><head><title>x</title><body>{ARTICLE}",
        f"<html><head><title>x</title><meta name=a><link rel=b><style>p{{}}</style>{ARTICLE}",
        f"<head><title>x</head><body>{ARTICLE}<svg><title>y</title></svg>",
        f"<head><title>x</title><style>p {{}}</head><body>{ARTICLE}",
        f"<head><script>document.write('<body></head>')</script></head><body>{ARTICLE}",
        *(f"<body><{tag} class=a>{ARTICLE}</body>" for tag in ("select", "object", "iframe", "video", "canvas", "svg", "audio", "template", "noscript")),
        f"<body><select><option>one {ARTICLE}<select><option>No text of the page at all</select>",
        f"<body><object>Other <object>words</object> that are left out here</object>{ARTICLE}",
        f"<body><svg><text>Words of a drawing that are no text of the page</text></svg>{ARTICLE}",
        f"<body><form id=aspnetForm action=/><input type=hidden><nav>Menu</nav>{ARTICLE}<div class=sidebar>{SENTENCE.format(3)}</div><footer>Foot</footer></form>",
        f"<body><a href=#m>Skip to content</a><form>{ARTICLE}</form>&nbsp;</body>",
        f"<body><div class=overlay><form>{ARTICLE}<button>Send</button></form></div></body>",
        f"<body><aside>{ARTICLE}</aside></body>",
        f"<body><div class=sidebar>{ARTICLE}</div><form>Find <input></form></body>",
    ],
)
def test_pages_keep_their_article(page):
    assert htmltext.extract(page, htmltext.vote(page)) == f"{SENTENCE.format(1)}\n\n{SENTENCE.format(2)}"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class='post'>{}</div>", "<main><div class='entry-content'>{}</div></main>"])
def test_generated_layouts_give_the_whole_article(around):
    """Every part of the article is there, in order, and nothing else."""
    rng = random.Random(around)
    parts = {
        "<h2>{}</h2>": "Heading {}", "<p>{}</p>": SENTENCE, "<section class='related-work'><p>{}</p></section>": SENTENCE,
        "<table class='alert-levels'><tr><td>{}</td></tr></table>": "Level {} of the alert", "<blockquote>{}</blockquote>": "Quoted words {}",
        "<ul><li>{}</li></ul>": "Item {} of the list", "<p>Where <math><mi>{}</mi></math> holds</p>": "x{}",
    }
    apart = [
        "<div class='related-posts'><a href=#>Other story</a></div>", "<div class='share-buttons'>Share this</div>", "<nav><a href=#>Home</a></nav>",
        "<div class='alert alert-box'>Our shop is closed</div>", "<script>var x = 1;</script>", "<form>Your mail <input></form>", "<div id=comments><p>Nice text, I like it</p></div>",
    ]
    for _ in range(25):
        chosen = [rng.choice(list(parts.items())) for _ in range(rng.randrange(4, 9))] + [("<p>{}</p>", SENTENCE)] * 3
        texts = [text.format(i) for i, (_, text) in enumerate(chosen)]
        body = "".join(tag.format(t) + (rng.choice(apart) if rng.random() < 0.4 else "") for (tag, _), t in zip(chosen, texts))
        references = "".join(f"<li><a href=#>A. Author, On the long title of a paper that is cited, volume {i}</a></li>" for i in range(4))
        page = f"<html><head><title>t</title></head><body><header><a href=/>Site</a></header>{around.format(body + f'<ol>{references}</ol>')}<footer>Foot</footer></body></html>"
        want = [f"Where {t} holds" if "math" in tag else t for (tag, _), t in zip(chosen, texts)]
        want += [f"A. Author, On the long title of a paper that is cited, volume {i}" for i in range(4)]
        assert htmltext.extract(page, htmltext.vote(page)).split("\n\n") == want


def test_hosts_agree_on_a_path(spark):
    good = "<body><div class=story><p>{}</p><p>{}</p></div><div class=box><p>{}</p></div></body>"
    rows = [(i, f"https://www.Site.example:80/{i}", good.format(SENTENCE.format(i), SENTENCE.format(i), "Short box text with some words in it.")) for i in range(6)]
    odd = good.format("Tiny news text, too short.", "", SENTENCE.format(1) * 5)
    rows += [(6, "http://site.example/odd", odd), (7, None, "<p>no host but text enough to be taken</p>"), (8, "http://x.example/", None), (9, "http://site.example/z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("own")).withColumn("host", F.lit("own"))
    winners = {r.host: (r.path, r.votes) for r in htmltext.host_paths(pages).collect()}
    assert winners["site.example"] == ("body/div.story", 6)
    got = {r.page_id: r for r in htmltext.main_text(pages).collect()}
    assert got[6].text == "Tiny news text, too short." and got[3].text == f"{SENTENCE.format(3)}\n\n{SENTENCE.format(3)}"
    assert got[7].text.startswith("no host") and (got[8].text, got[9].text, got[8].n_chars) == ("", "", 0)
    assert got[6].url == "http://site.example/odd" and htmltext.main_text(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def score(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_secrets_on_held_out_findings(spark, score):
    rows = secrets.featured(secrets.labelled_findings(spark, 2400, 5_000_000))
    said = rows.select("label", F.expr(score.replace("f.", "")).alias("s"))
    said = said.collect()
    right = sum((r.s >= secrets.THRESHOLD) == (r.label == 1) for r in said)
    assert right >= 0.97 * len(said) and len(said) > 2000


def test_secret_scan(spark, score):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [
        (0, f'some words token = "{key}"### and api_key="{key[:32]}" more'), (1, f"see commit {key} for that"), (2, None), (3, ""),
        (4, "mail that.92@mail2.example.com card 4785380592391139 call +1 (499) 555-6503"), (5, f'token = "{key}" ' * 3), (6, "x " * 30_000),
        (7, "https://www.example.com/the/path/1234567890123/index.html"),
    ]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in secrets.scan(docs, score).collect()}
    assert sorted(got[0].findings) == sorted([key, key[:32]]) and key not in got[0].redacted and key[:32] not in got[0].redacted
    assert got[1].findings == [] and got[1].n_candidates == 1 and got[1].redacted == rows[1][1]
    assert got[2].redacted is None and got[2].n_candidates == 0 and got[3].redacted == ""
    assert got[4].findings == [] and got[7].findings == [] and got[5].redacted == f'token = "{secrets.MARK}" ' * 3
    assert secrets.scan(docs.limit(0), score).count() == 0
    plan = secrets.scan(docs.select("doc_id", "text"), score)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_candidates(text):
    """Candidates by plain regular expressions, word by word."""
    ws = words(text)
    named = r"(?i:passw|passphrase|pwd|secret|token|api[_.-]?key|access[_.-]?key|private[_.-]?key|auth[_.-]?key|credential)[a-zA-Z0-9_.-]*[\"']?"
    assign, value = "(?:=>|:=|=|:)", r"[^\s\"'<>,;(){}\[\]`\\]{6,}"
    out = []
    for i, w in enumerate(ws):
        b1, b2 = ws[i - 1] if i else "", ws[i - 2] if i > 1 else ""
        own = [c for c in re.findall(r"[A-Za-z0-9+/_.~-]{16,}={0,2}", w) if re.search("[0-9]|[a-z][A-Z]", c)]
        own += re.findall(f"{named}{assign}[\"']?({value})", w)
        if re.search(f"{named}{assign}[\"']?$", b1) or (re.fullmatch(assign, b1) and re.search(f"{named}$", b2)):
            own += re.findall(f"^[\"'(]*({value})", w)
        out += dict.fromkeys(own)
    return out + re.findall("-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", text or "")


def brute_redact(text, findings):
    longest = sorted(findings, key=lambda f: (len(f), f), reverse=True)
    core = "[A-Za-z0-9+/_.~-]"
    return re.sub(f"(?<!{core})(?:{'|'.join(map(re.escape, longest))})(?!{core})", secrets.MARK, text) if findings else text


def test_secrets_against_brute_force(spark, score):
    rng = random.Random(31)
    key = "24be64439e3e49cf46b2d7c90f3602a3"
    alphabet = "abcXYZ019+/=_.-!\"':;, \n"
    bits = ["password", "api_key", "token", " = ", "=", ": ", ":=", '"', "'", key, key + "d0b907ff", "hunter2!x", "commit ", "correcthorsebattery", "\n"]
    rows = [f'api_key="{key}" and token = "{key}d0b907ff" x', f'a {key} b token="{key}"', 'password = "hunter2!x"', 'password="correcthorsebatterystaple"']
    rows += ["x\n-----BEGIN RSA PRIVATE KEY-----\nMIIE+abc/==\nqqqq\n-----END RSA PRIVATE KEY-----\ny", "passwd: a\\Eb123456 x", "", None, "word " * 40_000 + f'token = "{key}"']
    rows += ["".join(rng.choice(bits) if rng.random() < 0.5 else rng.choice(alphabet) for _ in range(60)) for _ in range(150)]
    docs = table(spark, [*enumerate(rows), (0, rows[0])]).withColumn("a.b", F.lit("own")).withColumn("cands", F.lit("own"))
    got = secrets.scan(docs, score).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = rows[r.doc_id]
        candidates = brute_candidates(text)
        assert r.n_candidates == len(candidates) and set(r.findings) <= set(candidates), text
        assert r.redacted == (text if text is None else brute_redact(text, r.findings)) and r["a.b"] == r.cands == r._words == "own"
    found = {r.doc_id: r.findings for r in got}
    assert sorted(found[0]) == [key, key + "d0b907ff"] and found[2] == ["hunter2!x"] and len(found[3]) == len(found[4]) == len(found[8]) == 1


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(12)
    base = [prose(rng, rng.randrange(30, 90)) for _ in range(8)]
    near = [b.replace(b.split()[3], "edited", 1) for b in base[:4]]
    rows = [None, "", "short", *base, *base[2:5], *near, "spam " * 200, f'{prose(rng, 40)} token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end']
    rows = list(enumerate(rows))
    docs = table(spark, rows).withColumn("n_chars", F.char_length("text").cast("long"))
    want = [(i, t) for i, t in rows if verdict(t)[1]]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in want}
            break
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name == "exact":
            keep = exact_groups(want)
            want = [(i, t) for i, t in want if keep[i][0] == i]
        elif name == "near":
            least = components(want)
            want = [(i, t) for i, t in want if least[i][1] == i]
        elif name == "secrets":
            want = [(i, t.replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", secrets.MARK)) for i, t in want]
        found = out.collect()
        assert sorted((r.doc_id, r.text) for r in found) == want and all(r.n_chars == len(r.text) and r.sender == "own" for r in found)
        docs = out
    assert len(want) == 9 and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_pipeline_with_ids_that_repeat_or_are_null(spark):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(1, a), (1, a), (2, b), (3, b), (3, c), (None, a), (None, d), (None, d), (None, e), (4, e), (5, d + "  "), (6, "f " * 9), (6, "f " * 9 + " ")]
    docs = table(spark, rows)
    exact = corpus_pipeline.exact_stage(spark, docs, "").cache()
    assert exact.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in exact.collect()) == sorted([(1, a), (2, b), (3, c), (4, e), (5, d + "  "), (6, "f " * 9 + " ")])
    edited = [x.replace(x.split()[30], "edited", 1) for x in (a, c)]
    rows = [(1, a), (7, edited[0]), (7, b), (None, edited[1]), (8, c), (None, d)]
    near = corpus_pipeline.near_stage(spark, table(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in near) == sorted([(1, a), (7, b), (8, c), (0, d)])


def test_pipeline_with_odd_tables(spark):
    import corpus_pipeline

    rng = random.Random(3)
    long = prose(rng, 20_000)
    rows = [(1, long), (2, long + " end"), (1, prose(rng, 70)), (None, None), (4, ""), (4, "")]
    docs = table(spark, rows).withColumn("a.b", F.lit("own")).withColumn("own_id", F.lit("own")).withColumn("_0", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0
        out = stage(spark, docs, "")
        if name == "packing":
            assert {(r.doc_id, r.doc_tokens) for r in out.where("doc_id = 4 OR doc_id IS NULL").collect()} == {(None, 1), (4, 1)}
            continue
        assert out.columns == docs.columns
        kept = out.collect()
        assert all(r["a.b"] == r.own_id == r["_0"] == r.sender == "own" for r in kept)
        ids = sorted((r.doc_id or 0, len(r.text or "")) for r in kept)
        n = [len(t or "") for _, t in rows]
        # the near stage compares rows of the same id and text as one; empty texts match nothing
        want = {"quality": [(1, n[0]), (1, n[2]), (2, n[1])], "exact": [(1, n[2]), (1, n[0]), (2, n[1]), (4, 0)], "secrets": None}
        if name in ("quality", "exact"):
            assert ids == sorted(want[name]), name
        elif name == "near":
            assert (2, n[1]) not in ids or (1, n[0]) not in ids
            assert (1, n[2]) in ids and (4, 0) in ids
        else:
            assert len(kept) == len(rows)


def _shuffled(spark):
    """Bytes that all stages of the session have written for shuffles so far."""
    jvm = spark._jvm
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["exact", "near"])
def test_texts_that_stay_are_not_shuffled(spark, tmp_path, name):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [" ".join(rng.randbytes(40).hex() for _ in range(400)) for _ in range(100)]
    rows = [(i, t, "en") for i, t in enumerate([*texts, *texts[:5]])] + [(1000, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were many ids to remove
    try:
        before = _shuffled(spark)
        dict(corpus_pipeline.STAGES)[name](spark, docs, "").write.parquet(f"{tmp_path}/out")
        moved = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, out.collect())) == [r for r in rows if not 100 <= r[0] < 105]
    assert moved < sum(map(len, texts)) / 3

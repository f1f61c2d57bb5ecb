from harvestry.llm import license_scan as L


def brute(text):
    best, n = [], 0
    for _, _, w in L.parts_of(text or ""):
        for k, t in L.TEMPLATES.items():
            d = L.dice(L.bigrams(w), L.bigrams(L.words_of(t)))
            if d >= L.THRESHOLD:
                n += 1
                best.append((-d, k))
    return (min(best)[1], -min(best)[0], n) if best else (None, None, 0)


def test_scan_equals_brute_force(spark):
    t = L.TEMPLATES
    texts = [t["MIT"], t["MIT"].upper() + "\n\nfoo bar", "x y\nReleased under the MIT license\nz", t["BSD-3-Clause"].replace("THIS", "SUCH"),
             t["BSD-2-Clause"].replace(". ", ".\n"), "a\n\n" + t["ISC"].replace(" and", "\nand") + "\n\nb", "Licensed under CC BY 4.0",
             "Licensed under CC BY-NC 4.0.", "plain prose about a license", None, "", "mit", t["GPL-3.0"][: len(t["GPL-3.0"]) // 2]]
    docs = spark.createDataFrame([(i, x, "c") for i, x in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: (r.license, r.dice, r.n_matches) for r in L.scan_licenses(docs).collect()}
    assert got == {i: brute(x) for i, x in enumerate(texts)}
    assert got[0][0] == "MIT" and got[2][0] == "notice:MIT" and got[8][0] is None
    assert L.scan_licenses(docs.limit(0)).collect() == []


def test_bounds_prune_only_impossible_templates():
    index = L.TemplateIndex(L.TEMPLATES, 0.8)
    for k, n in index.sizes.items():
        low, high = index.bounds[k]
        for m in range(1, 2 * n + 2):
            if 2 * min(m, n) / (m + n) >= 0.8:
                assert low <= m + 1e-9 and m <= high + 1e-9


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def best_by_brute_force(text, template):
    w, t = L.words_of(text), L.bigrams(L.words_of(template))
    return max((L.dice(L.bigrams(w[i:j]), t) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=0.0)


def test_every_span_is_compared(spark):
    """A header of several paragraphs inside a longer text, and a notice inside a line, against all word spans."""
    names = ("Apache-2.0", "notice:MIT", "notice:Apache-2.0", "MPL-2.0")
    templates = {k: L.TEMPLATES[k] for k in names}
    texts = ["Notes on a tool\n\nIt has a long story.\n\n" + APACHE + "\n\nThen the code of the tool begins here, under the hood.",
             "This corpus page is provided as is. Released under the MIT License. See the rest of the page for more.",
             "the license is the license of the file and you may obtain a copy of it at the door", "mit"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan_licenses(docs, templates).collect()}
    for i, x in enumerate(texts):
        best = {k: best_by_brute_force(x, t) for k, t in templates.items()}
        want = {k: d for k, d in best.items() if d >= L.THRESHOLD}
        have = {}
        for m in got[i].matches:
            have[m.license] = max(have.get(m.license, 0.0), m.dice)
        assert have == want, (i, have, want)
    assert got[0].license == "Apache-2.0" and got[0].dice == 1.0 and (4, 11, "Apache-2.0", 1.0) in map(tuple, got[0].matches)
    assert got[1].license == "notice:MIT" and got[1].dice == 1.0 and got[2].license is None


def test_spans_that_repeat_are_all_found():
    index = L.TemplateIndex({"a": "one two three four five", "b": "single"}, 0.8)
    words = "x one two three four five one two three four five y single z one two three".split()
    assert index.spans(words) == {(1, 6), (6, 11), (12, 13)}


def test_greedy_spans_equal_a_plain_greedy_search():
    """Best span first, then the best beside it, by trying all spans of random texts made of a template's words."""
    import random

    rng, template = random.Random(2), "a b c d e f g a b"
    index = L.TemplateIndex({"t": template}, 0.8)
    t = L.bigrams(template.split())
    for _ in range(300):
        words = [rng.choice("abcdefgx") if rng.random() < 0.3 else template.split()[i % 9] for i in range(rng.randrange(2, 40))]
        spans = [(-L.dice(L.bigrams(words[i:j]), t), i, -j) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
        want, spans = set(), sorted(s for s in spans if -s[0] >= 0.8)
        for _, i, j in spans:
            inside = tuple(words[i:i + 2]) in t and tuple(words[-j - 2:-j]) in t
            if inside and all(-j <= a or i >= b for a, b in want):
                want.add((i, -j))
        assert index.spans(words) == want


def test_long_texts_take_time_in_proportion():
    import time

    def seconds(text):
        start = time.process_time()
        n = sum(1 for _, _, w in L.parts_of(text) for _ in L.default_index().matches(w))
        return time.process_time() - start, n

    L.default_index()
    notices = [seconds("Released under the MIT License.\n" * n) for n in (800, 1600)]
    assert notices[0][0] < 0.5 and notices[1][0] < 3 * notices[0][0] + 0.1 and notices[1][1] >= 1600
    copies = [seconds((L.TEMPLATES["MIT"] + "\n\n") * n) for n in (20, 40)]
    assert copies[1][0] < 3 * copies[0][0] + 0.1 and copies[1][1] >= 40


def test_long_text_repeated_rows_and_null_ids(spark):
    prose = " ".join(f"w{i % 997}" for i in range(10_000))
    text = prose + "\n" + L.TEMPLATES["MIT:full"] + "\n" + prose
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "y"), (None, None, None)], "doc_id long, text string, license string")
    rows = L.scan_licenses(docs).collect()
    assert sorted(((r.doc_id, r.license, r.dice) for r in rows), key=str) == sorted([(1, "MIT", 1.0)] * 2 + [(None, "MIT", 1.0), (None, None, None)], key=str)
    assert all({(m.license, m.dice) for m in r.matches} >= {("MIT", 1.0), ("MIT:full", 1.0)} for r in rows if r.license)

"""Quality rules, personal data, secrets, licenses and language."""

import math
import re
import zlib
from collections import Counter

import pytest

from tomeweave.llm import langid, licenses, pii, quality, secrets

SPACE = "[^\x20\x09-\x0d]+"


# ----------------------------------------------------------------- quality
def plain_counts(text):
    text = text or ""
    w = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    long = " ".join(f"w{k % 37}" for k in range(500))
    texts = [None, "", "  \x0b ", "a b c", "a b c d e f g h " * 2, "x a b c d e f g h y a b c d e f g h z", "l\nl\n\n \nl \nl", "#*$%&|<> ñ 😀", long, "a " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'en' as lang")
    rows = quality.assess(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {r.doc_id: tuple(r[n] for n in names) for r in rows} == {k: plain_counts(t) for k, t in enumerate(texts)}
    assert {r.doc_id: r.base_failed for r in rows} == {k: (c := plain_counts(t))[0] < 20 or 100 * c[4] > 30 * c[0] for k, t in enumerate(texts)}


def test_divergent_texts_go_and_the_rest_stays(spark):
    good = [(k, " ".join(["the", f"house{k}", "of", f"stone{k}", "and", f"light{k * 7}"] * 1 + [f"the w{k}{j} of u{j}" for j in range(40)]), "en") for k in range(30)]
    bad = [(100, " | ".join(f"name{j}" for j in range(200)), "en"), (101, " ".join(f"W{j}###!!%%%" for j in range(200)), "en")]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in quality.kept_rows(docs).collect()} == {k for k, _, _ in good}


def test_quality_odd_rows(odd_docs, no_docs):
    rows = quality.assess(odd_docs).collect()
    assert len(rows) == odd_docs.count() and not any(r.kept for r in rows)
    assert quality.assess(no_docs).count() == 0
    assert quality.kept_rows(odd_docs).columns == odd_docs.columns


# ------------------------------------------------------------ personal data
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), n, m.end()) for n, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if valid(k, m.group())]
    return ",".join(f"{list(PATTERNS)[n]}:{a}:{b}" for a, n, b in sorted(found))


def test_base_spans(spark):
    texts = [
        None, "", "a@b.c", "x.y@b.c_d@e.f g@h", "a@b@c.d", "@a.b", "😀 é a+b%c@x-y.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.003.255 1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999 +12 34", "+49.30.123456-+1 2", "1" * 50, "4111111111111111 " * 3,
        "a." * 3_000 + "@" + "b." * 3_000 + "c", "+" * 500 + "1 " * 500, "9" * 20_000, "é" + "1.1.1.1 " * 700,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written("base").alias("s")).collect()}
    assert rows == {k: plain_spans(t) for k, t in enumerate(texts)}


def test_disclosing_terms(spark):
    near = [(k, f"filler{k} Zanzibar writes to boss@example.org about thing{k}", "en") for k in range(5)]
    far = [(10 + k, f"another text{k} about nothing writes here", "en") for k in range(200)]
    alone = [(900, "Zanzibar's zanzibar, ZANZIBAR", "en"), (901, "Zanzibarian", "en")]
    docs = spark.createDataFrame(near + far + alone, "doc_id bigint, text string, lang string")
    limits = pii.Settings(generalise=0.9)  # of 5 bits: few documents hold little information
    flagged = {r.term for r in pii.disclosing_terms(docs, limits).collect()}
    assert flagged == {"zanzibar"}
    rows = {r.doc_id: r for r in pii.find(docs, limits).collect()}
    assert [(s.start, s.end) for s in rows[900].terms] == [(11, 19), (21, 29)] and not rows[901].terms and not rows[10].terms
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, limits).collect()}
    assert clean[0] == "filler0 [TERM] writes to [EMAIL] about thing0" and clean[10] == far[0][1]


def test_scores_against_loops(spark):
    """Terms and their disclosure by sets: entities in any writing and their classes, evidence in different texts."""
    import random

    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "tu", "ve", "wi")]
    people = [("Ann.Kara@Mail1.example.com", "xantho"), ("+1 (555) 010-9999", "yellow"), ("+1 555 010 9999", "yellow"), ("10.20.30.40", "zulu"), ("10.20.30.41", "zulu")]
    rows = []
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(12)]
        if k % 6 == 0:
            value, mark = rng.choice(people)
            words[5:5] = [mark, value] if rng.random() < 0.8 else [value]
        rows.append((k, " ".join(words)))
    rows += [(200 + k, rows[6][1]) for k in range(4)] + [(300, "zulu alone"), (301, None)]
    texts, n = [t or "" for _, t in rows], len(rows)
    term, settings = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[^\W\d_]|['-])+(?![^\W\d_'-])"), pii.Settings(generalise=0.8, evidence=0.5)

    def classes(hit):
        if "@" in hit:
            local, domain = hit.lower().split("@")
            return {"email", f"email:{hit.lower()}", f"domain:{domain}", *(f"name:{x}" for x in term.findall(local))}
        if hit[0] == "+":
            d = re.sub("[^0-9]", "", hit)
            return {"phone", f"phone:{d}", f"area:{d[:4]}"}
        return {"ip", f"ip:{hit}", f"net:{hit.rsplit('.', 1)[0]}"}

    entity, held, both = {}, {}, {}
    for d, t in enumerate(texts):
        for w in set(term.findall(t.lower())):
            held.setdefault(w, set()).add(d)
        for m in re.finditer(r"\S+@\S+|\+1[ (][0-9 ()-]+[0-9]|10\.20\.30\.4\d", t):
            before, after = t[max(0, m.start() - 96) : m.start()], t[m.end() : m.end() + 96]
            near = set(term.findall((re.sub(r"^\S*", "", before) + " " + re.sub(r"\S*$", "", after)).lower()))
            for e in classes(m.group()):
                entity.setdefault(e, set()).add(d)
                for w in near:
                    both.setdefault((e, w), set()).add(d)
    want = {}
    for (e, w), docs in both.items():
        info = -math.log2(len(entity[e]) / n)
        share = (math.log2(min(1, len(docs) / len(held[w]))) + info) / info
        shown = len({texts[d] for d in docs})
        if share >= 0.8 and share * shown / (shown + 1) >= 0.5:
            want[w] = max(share, want.get(w, 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.term: r.disclosure for r in pii.disclosing_terms(df, settings).collect()}
    assert {"xantho", "yellow", "zulu"} <= set(want) and set(got) == set(want)
    assert all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_terms_beyond_the_higher_threshold_are_removed(spark):
    rows = [(k, f"by Pablo writes from p.pablo{k}@example.org unto mo{k}") for k in range(9)] + [(50 + k, f"nothing here {k}") for k in range(400)] + [(900, "so Pablo, again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    limits = pii.Settings(generalise=0.5, remove=0.9)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, limits).collect()}
    assert clean[0] == "by    [EMAIL]  mo0" and clean[900] == "so , again" and clean[50] == "nothing here 0"
    spans = {r.doc_id: r.s for r in pii.find(docs, limits).select("doc_id", pii.written("terms").alias("s")).collect()}
    assert spans[900] == "removed:3:8" and spans[50] == ""


def test_personal_data_odd_rows(odd_docs, no_docs):
    assert pii.find(odd_docs).count() == odd_docs.count() and pii.find(no_docs).count() == 0


# ----------------------------------------------------------------- secrets
@pytest.fixture(scope="module")
def scanner(spark):
    text = "the ship that sailed from the harbour when morning came with bread and light upon every window of our small house by the river "
    docs = spark.createDataFrame([(k, f"{text} {k} " * 4) for k in range(300)], "doc_id bigint, text string")
    return secrets.prepared(docs)


def test_secrets(spark, scanner):
    key = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    rows = [
        (1, f'é it is token = "{key}" here', True), (2, f"commit {key} here", False), (3, "a thatsailedfromtheharbour word", False),
        (4, "see /ship/that/sailed/from/harbour.html now", False), (5, "=" * 60 + "-" * 60, False), (6, None, False), (7, f"secret: {key} and password={key[::-1]}", True),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, secret boolean")
    found = {r.doc_id: r for r in secrets.scan(docs, *scanner).collect()}
    assert {k: bool(r.secrets) for k, r in found.items()} == {k: s for k, _, s in rows}
    for k, text, _ in rows:
        for c in found[k].candidates:
            assert text[c.start : c.end] == c.value
    masked = {r.doc_id: r.text for r in secrets.masked(docs, *scanner).collect()}
    assert masked[1] == 'é it is token = "[SECRET]" here' and masked[7] == "secret: [SECRET] and password=[SECRET]"
    assert all(masked[k] == t for k, t, s in rows if not s)


def test_many_candidates_have_right_places(spark, scanner):
    text = " ".join(f"{k:024x}" for k in range(900))
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), *scanner).first()
    assert [(c.start, c.value) for c in row.candidates] == [(25 * k, f"{k:024x}") for k in range(900)]


def test_secrets_odd_rows(odd_docs, no_docs, scanner):
    assert secrets.scan(odd_docs, *scanner).count() == odd_docs.count()
    assert secrets.masked(odd_docs, *scanner).exceptAll(odd_docs).count() == 0
    assert secrets.scan(no_docs, *scanner).count() == 0


# ---------------------------------------------------------------- licenses
def test_band_settings_are_checked():
    with pytest.raises(ValueError):
        licenses.prepare(bands=licenses.Bands(4, 2))


def test_licenses_against_containment(spark):
    lead = " ".join(f"w{k}" for k in range(300))
    texts = [None, "", "mit"]
    for k, notice in enumerate(licenses.TEMPLATES.values()):
        texts += [notice, f"{lead[: 37 * k]} {notice.upper()} {lead}", notice[: len(notice) // 2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ready = licenses.prepare()
    for row in licenses.scan(docs, ready).collect():
        have = set(licenses._shingles((texts[row.doc_id] or "").encode()))
        assert {f.license for f in row.found} == {t.name for t in ready.each if len(t.shingles & have) >= 0.8 * len(t.shingles)}


def test_licenses_odd_rows(odd_docs, no_docs):
    assert licenses.scan(odd_docs).where("size(found) = 0").count() == odd_docs.count() and licenses.scan(no_docs).count() == 0


# ---------------------------------------------------------------- language
def test_language(spark):
    en = "the house of the king and the river that they should have with some other words which were thought through "
    de = "das haus des königs und der fluss den sie mit einigen anderen wörtern haben sollten die gedacht wurden schön "
    es = "la casa del rey y el río que ellos debían tener con algunas otras palabras que fueron pensadas mañana niño "
    rows = [(k, (x := (en, de, es)[k % 3])[k % 50 :] + x, ("en", "de", "es")[k % 3]) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.fit(docs, langid.Settings(steps=120))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r.doc_id for r in docs.where(langid.held_out(docs.doc_id)).collect()} == {r[0] for r in held}
    got = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    spans = langid.label_spans(docs.limit(2), net).collect()
    assert sum(r.end - r.start for r in spans) == sum(len(t.encode()) for _, t, _ in docs.limit(2).collect())


def test_language_odd_rows(odd_docs, no_docs):
    net = langid.fit(odd_docs, langid.Settings(steps=3))
    rows = langid.predict(odd_docs, net).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert langid.fit(no_docs) is None and langid.predict(no_docs, None).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, None).collect()} == {"und"}

"""Personal data and secrets against Python's regular expressions."""

import hashlib
import math
import random
import re

from fennelmill.llm import pii, secrets

DOC = "doc_id long, text string, lang string, source string, email string, base int"
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ASSIGN = r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def valid(kind, v):
    n = len(re.sub("[^0-9]", "", v))
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 12 <= n <= 19 and luhn(v), "phone": 9 <= n <= 15}[kind]


def personal(t):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PII.items()) for m in re.finditer(p, t or "") if valid(k, m.group()))


def secret(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 16])


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def random_texts(pieces, seed):
    rng = random.Random(seed)
    fixed = ["", None, "a@b.com_x@y.zz", "..@a.b.c..d", "1.2.3.4.5.6.7.8", "001.02.3.255 256.1.1.1", "4111 1111-1111 1111", "4111  1111", "+1 (5) 55-5.5555 ", "😀 a@b.cc 😀 1.1.1.1", "1" * 5000, "1-" * 4000, "a" * 5000 + "@" + "b." * 3000 + "c", "1.1.1.1 " * 300,
             "password=token=abcdefghijklmnop", "secret: token: abcdefghijkl", "API_KEY = 'abcdefghijkl'", "AKIA" * 9, "f" * 40, "Tokenſ=abcdefghijklmnop"]
    return fixed + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(400)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 5}", "own", 1) for i, t in enumerate(texts)], DOC)


def test_personal_base_spans(spark):
    texts = random_texts(["a", "b.", "@", "c-d", "x.com", "+", "1", "42", ".", " ", "-", "(", ")", "255", "256", "4111111111111111", "+1 938 555-0822", "é", "😀", "_", "\n", "%"], 1)
    got = {r.doc_id: r for r in pii.digests(pii.find_personal_data(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        spans = personal(t)
        assert got[i].base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[3] == k for s in spans) for k in PII)
        assert set(filter(None, written(spans).split(","))) <= set(got[i].spans.split(","))
    assert pii.digests(pii.find_personal_data(frame(spark, texts).where("false"))).count() == 0


def test_context_finds_unseen_identifiers(spark):
    texts = [f"please call me: +1 938 555-{1000 + i} soon" for i in range(12)] + ["please call me: 555-0134-77x. soon", "it cost 555-0134-77x once", "me: 4242424"]
    got = {r.doc_id: r for r in pii.digests(pii.find_personal_data(frame(spark, texts))).collect()}
    a = texts[12].index("555")
    assert got[12].spans == f"phone:{a}:{a + 12}" and got[12].n_found == 1 and got[12].n_phone == 0
    assert got[13].spans == "" and got[0].n_found == 0


def test_context_finds_addresses_without_digits(spark):
    unseen = ["bob@localhost", "jane.doe@intranet", "a@b", "jane(at)example.com", "jane [ AT ] example.com", "(jane[at]example.com)", "jane at example dot co dot uk", "room-1234"]
    prose = ["tomorrow", "@home", "b2b", "look"]
    texts = [f"you may write to: user{chr(97 + i % 26)}{chr(97 + i // 26)}@mail.example soon" for i in range(60)] + [f"you may write to: {x}, soon" for x in unseen + prose] + ["it was bob@localhost once", "look (at) this"]
    got = {r.doc_id: r for r in pii.digests(pii.find_personal_data(frame(spark, texts))).collect()}
    for i, x in enumerate(unseen, 60):
        inner = x.strip("()")
        a = texts[i].index(inner)
        assert got[i].spans == f"email:{a}:{a + len(inner)}" and got[i].n_found == 1 and got[i].n_email == 0, x
    assert all(got[i].spans == "" for i in range(60 + len(unseen), len(texts)))
    left = {r.text for r in pii.redact(frame(spark, texts)).collect()}
    assert "you may write to: [EMAIL], soon" in left and not any(x in t for x in unseen[:2] for t in left if t.startswith("you"))
    few = {**pii.LEAST, "email": (3, 1)}
    assert {r.doc_id: r.n_found for r in pii.find_personal_data(frame(spark, texts), least=few).selectExpr("doc_id", "size(found) n_found").collect()}[60 + len(unseen) + 2] == 1


def test_redaction(spark):
    texts = ["mail a@b.cc, now", None, "none", "+1 938 555-0822, 4111111111111111", "mail a@b.cc, now"]
    df = spark.createDataFrame([(i if i else None, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, __hash string")
    got = sorted(((r.text or "", r.n_chars) for r in pii.redact(df).collect()))
    assert [x for x, _ in got] == ["", "[PHONE], [CARD]", "mail [EMAIL], now", "mail [EMAIL], now", "none"]
    assert [n for _, n in got] == [9, 15, 17, 17, 4]
    assert pii.redact(df.where("false")).count() == 0


def test_secret_base_spans(spark):
    texts = random_texts(["password", "token", "TOKEN", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "abc", "123456789012", "AKIA", "ABCDEF0123456789", "deadbeef", "0", "x", "\n", ".", "é"], 2)
    got = {r.doc_id: r for r in secrets.digests(secrets.find_secrets(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        spans = secret(t)
        assert got[i].base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(filter(None, written(spans).split(","))) <= set(got[i].spans.split(","))
    assert secrets.digests(secrets.find_secrets(frame(spark, texts).where("false"))).count() == 0


def test_owners_tell_live_secrets_from_copied_examples(spark):
    live, copied = "Zk3vQ9xLp2Wm8RtYb5Nc", "Hq7Bd1Kf6Ps4Gj0Vw9Xa"
    rows = [(0, f"key {live} here", "s0"), (1, f"key {live} again", "s0")] + [(2 + i, f"try {copied} as shown", f"s{i}") for i in range(4)] + [(9, "password=abcdefghijkl12345678", "s9"), (10, None, None)]
    got = {r.doc_id: r for r in secrets.digests(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[0].spans == f"generic:4:{4 + len(live)}" and got[0].n_live == 1 and got[1].n_live == 1
    assert got[2].spans == "" and got[2].n_copied == 1 and got[2].n_live == 0
    assert got[9].n_assign == 1 and got[9].n_live == 0 and got[10].spans == ""


def test_no_gap_between_live_and_copied_and_repositories_count(spark):
    two, wide = "Zk3vQ9xLp2Wm8RtYb5Nc", "Hq7Bd1Kf6Ps4Gj0Vw9Xa"
    rows = [(i, f"key {two} here", f"s{i}", "en") for i in range(2)] + [(2 + i, f"try {wide} now", "s0", f"l{i}") for i in range(5)]
    got = {r.doc_id: r for r in secrets.digests(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))).collect()}
    assert all(got[i].spans == f"generic:4:{4 + len(two)}" and (got[i].n_live, got[i].n_copied) == (1, 0) for i in range(2))
    assert all(got[i].spans == "" and (got[i].n_live, got[i].n_copied) == (0, 1) for i in range(2, 7))


def test_many_contexts_of_noise_make_no_pattern(spark):
    noise = [(f"c{c}", f"word{v}", None) for c in range(60) for v in range(96)]
    seeds = [(f"c{c}", f"+1 938 555 {c:02d}{s:02d}", "phone") for c in range(60) for s in range(4)]
    patterns, known = pii.bootstrap(spark.createDataFrame(noise + seeds, "context string, value string, seed string"))
    assert patterns.count() == 0 and known.count() == 0


def test_bootstrap_reaches_a_second_pattern_and_stops_at_noise(spark):
    """``call`` is promoted by its seeds; what it finds makes ``ring`` a pattern, which finds more. ``buy`` shares one value only."""
    rows = [("call", f"p{i}", "phone") for i in range(40)] + [("call", f"u{i}", None) for i in range(4)]
    rows += [("ring", f"p{i}", "phone") for i in range(40, 60)] + [("ring", f"u{i}", None) for i in range(4)] + [("ring", f"v{i}", None) for i in range(3)]
    rows += [("buy", f"n{i}", None) for i in range(50)] + [("buy", "u0", None), ("call", "n0", None)] + [(f"x{c}", "n0", None) for c in range(30)] + [("buy", "p0", "phone")]
    frame = spark.createDataFrame(rows, "context string, value string, seed string")
    first, known_first = pii.bootstrap(frame, rounds=1)
    assert {r.context for r in first.collect()} == {"call"} and not {r.value for r in known_first.collect()} & {f"v{i}" for i in range(3)}
    patterns, known = pii.bootstrap(frame)
    found = {r.value for r in known.collect()}
    wanted = {f"u{i}" for i in range(4)} | {f"v{i}" for i in range(3)}
    assert {r.context for r in patterns.collect()} == {"call", "ring"}
    assert len(found & wanted) / len(wanted) >= 0.8 and len(found & wanted) / len(found) >= 0.8 and "n0" not in found


def test_contexts_are_whole_words_and_many_matches_cost_little(spark):
    long = "w" * 300
    texts = [f"call {long}: +1 938 555-{1000 + i} soon" for i in range(12)] + [f"call x{long}: 555-0134-77x soon", f"call {long}: 555-0134-77x soon", "1.1.1.1 " * 40_000]
    got = {r.doc_id: r for r in pii.digests(pii.find_personal_data(frame(spark, texts))).collect()}
    assert got[12].n_found == 0 and got[13].n_found == 1 and got[14].n_ip == 40_000
    assert got[14].spans.endswith(f"ip:{8 * 39_999}:{8 * 39_999 + 7}")


def brute_found(texts, rounds=3, confidence=0.8, support=4, accepted=0.5):
    """Contextual extraction by plain loops: the found spans of each text."""
    token = re.compile(pii._TOKEN, re.A)
    kind_of = lambda v: "email" if re.search(PII["email"], v) else "phone" if v[0] == "+" and valid("phone", v) else next((k for k in ("ip", "card") if (m := re.search(PII[k], v)) and valid(k, m.group())), None)
    rows = []
    for t in texts:
        at, found = 0, []
        for m in token.finditer(t or ""):
            words = re.split(r"\s+", t[at : m.start()].strip(" \t\n\r\f\v"), flags=re.A)[-2:]
            at, raw = m.end(), m.group()
            lead = len(re.match(r"[^A-Za-z0-9+@]*", raw).group())
            trail = len(re.search(r"[^A-Za-z0-9]*$", raw).group())
            value = raw[lead : max(lead, len(raw) - trail)].lower()
            found.append((m.start() + lead, m.end() - trail, value, " ".join(words).lower(), kind_of(raw)))
        rows.append(found)
    edges = {}
    for _, _, value, context, seed in (x for r in rows for x in r):
        if context and value:
            edges[context, value] = max(filter(None, (edges.get((context, value)), seed)), default=None)
    by_context, by_value, known, promoted = {}, {}, {}, {}
    for (c, v), s in edges.items():
        by_context.setdefault(c, []).append((v, s))
        by_value.setdefault(v, []).append(c)
    for _ in range(rounds):
        scored = {}
        for c, inst in by_context.items():
            each = []
            for k in PII:
                seeds = sum(s == k for _, s in inst)
                learnt = [known[v][1] for v, s in inst if s is None and v in known and known[v][0] == k]
                each.append(((seeds + sum(learnt)) / (len(inst) + 1), seeds, seeds + len(learnt), k))
            scored[c] = max(each)
        promoted = {c: x for c, x in scored.items() if x[0] >= confidence and x[2] >= support and 2 * x[1] >= x[2]}
        new = {}
        for v, contexts in by_value.items():
            pointed = [(promoted[c][0], promoted[c][3]) for c in contexts if c in promoted and edges[c, v] is None]
            if pointed:
                k = max(pointed)[1]
                size = lambda c: math.log1p(len(by_context[c]))
                score = sum(size(c) * scored[c][0] * (scored[c][3] == k and scored[c][0] > 0) for c in contexts) / sum(map(size, contexts))
                if score >= accepted:
                    new[v] = (k, score)
        known = new
    out = []
    for t, found in zip(texts, rows):
        base, spans = personal(t), set()
        for a, b, value, context, seed in found:
            if seed is None and context in promoted and value in known and known[value][0] == promoted[context][3]:
                k = promoted[context][3]
                n, digits = len(re.sub("[^a-z0-9]", "", value)), len(re.sub("[^0-9]", "", value))
                likely = n >= pii.LEAST[k][0] and digits >= pii.LEAST[k][1] or k == "email" and re.search(pii._ADDRESS, value, re.A)
                if likely and not any(x < b and y > a for x, _, y, _ in base):
                    spans.add((a, list(PII).index(k), b, k))
        out.append(sorted(spans))
    return out


def checked(digits):
    """The digits with the one that makes them pass the check."""
    return next(d for d in (f"{digits}{k}" for k in range(10)) if valid("card", d))


def planted(docs, seed):
    """Documents with identifiers behind lead-ins, and where they are: known forms of three kinds, unseen forms, and the same forms behind prose."""
    rng = random.Random(seed)
    leads = {"phone": ["call me at", "phone number is"], "email": ["write to", "my address is"], "card": ["card number"]}
    known = {"phone": lambda: f"+1 938 555-{rng.randrange(10**4):04d}", "email": lambda: f"u{rng.randrange(10**6)}@mail{rng.randrange(99)}.example.com", "card": lambda: checked(f"4{rng.randrange(10**14):014d}")}
    unseen = {
        "phone": lambda: rng.choice([f"0938-555-{rng.randrange(10**4):04d}", f"938.555.{rng.randrange(10**4):04d}x"]),
        "email": lambda: rng.choice([f"j{rng.randrange(10**6)}[at]host", f"anne{rng.choice('abcdef')}{rng.choice('abcdef')} at mail{rng.choice('xyz')} dot org", f"k{rng.randrange(10**6)}@intranet"]),
        "card": lambda: f"41{rng.randrange(10**6):06d}-{rng.randrange(10**4):04d}",
    }
    out, wanted = [], []
    for t in docs:
        spans, kind, dice = [], rng.choice(list(leads)), rng.random()
        if dice < 0.3:
            unknown = dice < 0.03
            value = (unseen if unknown else known)[kind]()
            lead = rng.choice(leads[kind]) if dice < 0.29 else "it was seen that"
            head = f"{t} {lead} "
            if unknown:
                spans.append((len(head), len(head) + len(value), kind))
            t = f"{head}{value} and more"
        elif dice < 0.34:
            t = f"{t} the build of {rng.choice(['v2', 'run-1234-x', '2024-01-09', 'a-77812-b', 'mail at noon dot matrix'])} is out"
        out.append(t)
        wanted.append(spans)
    return out, wanted


def test_planted_identifiers_are_found(spark):
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts, wanted = planted(docs * 3, 1)
    got = {r.doc_id: {(s.start, s.end, s.kind) for s in r.found} for r in pii.find_personal_data(frame(spark, texts)).collect()}
    want = {(i, *s) for i, spans in enumerate(wanted) for s in spans}
    found = {(i, *s) for i, spans in got.items() for s in spans}
    recall, precision = len(found & want) / len(want), len(found & want) / len(found)
    assert len(want) > 60 and recall >= 0.9 and precision >= 0.95, (recall, precision)


def test_planted_secrets_are_told_apart(spark):
    """Keys of one owner each are reported in full, examples that owners share never, and nothing else."""
    rng = random.Random(8)
    docs = [(r.text or "", r.source, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    key = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") + rng.choice("abcdefghjkmnpqrstuvwxyz") + rng.choice("23456789") for _ in range(8))
    shared, rows, want = [key() for _ in range(3)], [], set()
    for i, (t, source, lang) in enumerate(docs):
        dice = rng.random()
        if dice < 0.1:
            head, value = f"{t} use ", key()
            want.add((i, len(head), len(head) + len(value)))
            t = f"{head}{value} here"
        elif dice < 0.3:
            t = f"{t} as in {rng.choice(shared)} above"
        rows.append((i, t, source, lang))
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    found = {(r.doc_id, s.start, s.end) for r in got for s in r.found}
    assert len(want) > 50 and found == want
    assert sum(r.n_copied for r in got) >= sum(any(s in t for s in shared) for _, t, _, _ in rows)


def test_found_spans_against_plain_loops(spark):
    rng = random.Random(11)
    leads = ["call me", "Ring  us at", "mail", "write to", "see", "card no", "host", "it is"]
    values = [f"+1 938 555-{1000 + i}" for i in range(25)] + [f"u{i}@x.example" for i in range(25)] + [f"10.0.0.{i}" for i in range(20)] + [f"55{i}-0134-x7" for i in range(12)] + [f"ref{i:03d}" for i in range(12)] + [f"n{i}(at)site" for i in range(6)] + [f"w{i}@host{i}" for i in range(6)]
    likes = {"call me": values[:25] + values[70:82], "Ring  us at": values[10:25] + values[76:84], "mail": values[25:50] + values[94:], "write to": values[25:45] + values[94:100], "host": values[50:70] + values[82:86]}
    texts = []
    for _ in range(260):
        says = lambda lead: f"{lead} {rng.choice(likes.get(lead, values[82:]) if rng.random() < 0.97 else values)}"
        texts.append(rng.choice(["", "", "so: "]) + " ".join(says(rng.choice(leads)) for _ in range(rng.randint(1, 3))) + rng.choice(["", ".", ", soon"]))
    want = brute_found(texts, confidence=0.5)
    assert sum(map(len, want)) > 20
    got = {r.doc_id: r.found for r in pii.find_personal_data(frame(spark, texts), confidence=0.5).collect()}
    for i, spans in enumerate(want):
        assert [(s.start, s.place, s.end, s.kind) for s in got[i]] == spans, texts[i]


def test_personal_and_secret_spans_by_sql(spark):
    """The contract's patterns in DuckDB, on texts made to break them."""
    import duckdb

    from fennelmill.llm import span_sql

    pieces = ["a", "b.", "@", "c-d", "x.com", "+", "1", "42", ".", " ", "-", "(", ")", "255", "256", "4111111111111111", "+1 938 555-0822", "é", "password", "TOKEN", "api_key", "=", ":", "'", '"', "123456789012", "AKIA", "ABCDEF0123456789", "deadbeef", "\n", "Zk3vQ9xLp2Wm8RtYb5Nc"]
    texts = random_texts(pieces, 6)
    df = frame(spark, texts)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    for sql, got in ((span_sql.SECRETS, secrets.digests(secrets.find_secrets(df))), (span_sql.PERSONAL, pii.base_digests(df))):
        names = sorted(got.columns)
        rows = con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        for a, b in zip(sorted(tuple(r[c] for c in names) for r in got.collect()), sorted(rows)):
            assert a == b

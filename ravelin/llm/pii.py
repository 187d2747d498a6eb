"""Personal data by weak supervision, in DataFrame functions only.

Four kinds follow fixed rules (the base spans). Beyond these, wide patterns propose candidates, and labelers vote on each: patterns of its shape, a
gazetteer of words before it, the marks around it, what else its text holds, and how varied it is. Expectation-maximisation
estimates from the counts of vote patterns over all documents how reliable each labeler is in either class, and so a probability for each pattern; a logistic
classifier of candidate features is trained on these and decides which candidates become spans.

What reaches the driver is one row for each combination of votes and features, whose number is bounded by the labelers and features, not by the data.
Candidates and spans of a text stay in its row, so that nothing is shuffled but those counts. Texts are searched in pieces of about :data:`PIECE` characters, cut
where no pattern can go across, so that the work grows with a text's length and not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds, in the order that breaks ties, and their patterns. The guards and possessive quantifiers only keep a long run from being tried from each of its characters; they change no match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words before a name, of English, German, French and Spanish
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Madam", "Herr", "Herrn", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Sr", "Sra", "Srta", "Señor", "Señora", "Señorita", "Don", "Doña"]
_NAME = r"\p{Lu}[\p{L}\p{M}’'-]*\p{L}\p{M}*+"
#: Kinds that the method adds, and what proposes them
ADDED = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "number": r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){6,}+",
    "name": rf"(?<![\p{{L}}\p{{M}}])(?:{'|'.join(TITLES)})\.?\x20{_NAME}(?:\x20{_NAME})?",
}
KINDS = [*BASE, *ADDED]
#: Words that announce personal data or a secret, by language
FOR = {
    "en": ["account", "address", "api", "apikey", "auth", "bearer", "born", "call", "contact", "credential", "customer", "employee", "fax", "iban", "id", "key", "licence", "member", "mobile", "name", "owner", "passport", "password", "passwd", "patient", "phone", "pin", "secret", "ssn", "tel", "token", "user"],
    "de": ["adresse", "anschrift", "ausweis", "handy", "konto", "kontonummer", "kennwort", "kunde", "kundennummer", "passwort", "reisepass", "rufnummer", "schlüssel", "steuernummer", "telefon"],
    "fr": ["adresse", "clé", "client", "compte", "contacter", "jeton", "joindre", "passeport", "portable", "téléphone"],
    "es": ["clave", "cliente", "contraseña", "cuenta", "dirección", "dni", "llamar", "móvil", "pasaporte", "teléfono", "usuario"],
}
#: Words that announce other numbers, by language
AGAINST = {
    "en": ["chapter", "commit", "edition", "figure", "isbn", "issn", "license", "md5", "page", "rfc", "section", "sha1", "sha256", "table", "version", "volume"],
    "de": ["abbildung", "absatz", "auflage", "ausgabe", "band", "kapitel", "seite", "tabelle"],
    "fr": ["chapitre", "figure", "numéro", "page", "tableau", "tome", "édition"],
    "es": ["capítulo", "edición", "figura", "página", "sección", "tabla", "tomo", "versión"],
}
LABELERS = ("shape", "gazetteer", "marks", "company", "variety")
FEATURES = ("secret", "number", "name", "long", "hex", "joined", "assigned", "quoted", "announced", "denied", "company", "varied", "capital")
#: Characters of a piece
PIECE = 2000
#: Where a text may be cut, before what this finds: no pattern has these characters in it, nor a space before a small letter, and no labeler looks behind a candidate for them.
_CUT = r"[\n\r\t,;|<>{}\[\]]|\x20\p{Ll}"
_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def _empty() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column, block: int = 512) -> Column:
    """The sum of all numbers before each of an array, by blocks, as what is appended to an array copies it."""
    blocks = lambda s: F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
    cut = lambda s, i: F.slice(s, i * block + 1, F.lit(block))
    total = lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x)

    def within(s: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(s, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def of(s: Column) -> Column:
        sums = F.transform(blocks(s), lambda i: total(cut(s, i)))
        return _let(sums, lambda t: F.flatten(F.transform(blocks(s), lambda i: within(cut(s, i), total(F.slice(t, F.lit(1), i))))))

    return _let(sizes, lambda s: F.when(F.size(s) > 1, of(s)).otherwise(F.transform(s, lambda x: F.lit(0))))


def pieces(text: Column, size: int = PIECE) -> Column:
    """A text as an array of ``at`` (where a piece begins, in code points), ``text`` and ``before`` (the last 40 characters of the piece before it). A piece without a place to cut it may be longer."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}(?=(?:{_CUT})|\z)|.+?(?=(?:{_CUT})|\z)"), F.lit(0))

    def placed(parts: Column) -> Column:
        before = F.transform(parts, lambda p, i: F.when(i > 0, F.right(F.get(parts, i - 1), F.lit(40))).otherwise(""))
        whole = F.arrays_zip(running(F.transform(parts, F.length)).alias("at"), parts.alias("text"), before.alias("before"))
        return F.transform(whole, lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text"), x["before"].alias("before")))

    one = F.array(F.struct(F.lit(0).alias("at"), text.alias("text"), F.lit("").alias("before")))
    return F.when(F.length(text) <= size, one).otherwise(_let(cut, placed))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern in a piece with their places in code points: leftmost, not overlapping."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), _empty().alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["before"])
        stop = start + F.length(x["value"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda v, b: F.struct(v.alias("value"), b.alias("before")))
    return F.aggregate(pairs, state, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(2 * d.try_cast("int") - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    n = F.length(_digits(span["value"]))
    if kind == "ip":
        parts = F.split(span["value"], r"\.")
        return F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(parts, lambda p: F.coalesce(F.right(p, F.lit(9)).try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(span["value"]))).otherwise(False)
    return n.between(10, 15)


def _base(text: Column) -> Column:
    """The spans of the base kinds in a piece, sorted by start and kind."""
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]")}
    parts = []
    for kind, pattern in BASE.items():
        found = matches(text, pattern, kind)
        parts.append(F.when(gate[kind], found if kind == "email" else _kept(found, kind)).otherwise(_empty()))
    return F.array_sort(F.concat(*parts))


def _kept(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: _valid(kind, s))


def _moved(spans: Column, at: Column) -> Column:
    """A piece's spans with their places in the text."""
    return F.transform(spans, lambda s: F.struct((s["start"] + at).alias("start"), s["rank"].alias("rank"), (s["stop"] + at).alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """The spans of the base kinds, sorted by start and kind. Null texts have none."""
    return F.flatten(F.transform(pieces(F.coalesce(text, F.lit(""))), lambda p: _moved(_base(p["text"]), p["at"])))


def _proposals(text: Column, base: Column) -> Column:
    """Candidates of the added kinds that overlap neither base spans nor earlier kinds' candidates."""
    taken = _empty()
    for kind, pattern in ADDED.items():
        taken = _with(taken, F.when(text.rlike(pattern), matches(text, pattern, kind)).otherwise(_empty()), base)
    return taken


def _overlaps(s: Column, spans: Column) -> Column:
    return F.exists(spans, lambda o: (o["start"] < s["stop"]) & (s["start"] < o["stop"]))


def _with(taken: Column, found: Column, base: Column) -> Column:
    return F.concat(taken, F.filter(found, lambda s: ~_overlaps(s, base) & ~_overlaps(s, taken)))


def _words(words: dict[str, list[str]]) -> str:
    return r"(?iu)(?<!\p{L})(?:" + "|".join(dict.fromkeys(w for some in words.values() for w in some)) + r")(?!\p{L})"


def _described(piece: Column, proposals: Column, company: Column) -> Column:
    """Each candidate with its votes (1: personal, -1: not, 0: no say) and features (0 or 1)."""
    text = piece["text"]

    def describe(s: Column) -> Column:
        own = F.substring(text, F.greatest(F.lit(1), s["start"] - 39), F.least(s["start"], F.lit(40)))
        before = F.right(F.concat(piece["before"], own), F.lit(40))
        after = F.substring(text, s["stop"] + 1, F.lit(2))
        value, kind = s["value"], s["kind"]
        plain = F.regexp_replace(value, r"[\x20.-]", "")
        size = F.length(plain)
        various = F.size(F.array_distinct(F.split(plain, "")))
        said, denied = before.rlike(_words(FOR)), before.rlike(_words(AGAINST))
        assigned, quoted = before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"[\"']$") & after.rlike(r"^[\"']")
        is_hex, joined = plain.rlike("^[0-9a-fA-F]+$") & plain.rlike("[a-fA-F]"), plain == value
        date = value.rlike(r"^(?:19|20)[0-9]{2}[.-]?[01][0-9][.-]?[0-3][0-9]")
        vote = lambda yes, no: F.when(no, -1).when(yes, 1).otherwise(0)
        votes = [
            vote(F.when(kind == "secret", is_hex & (size >= 32) | value.rlike("[a-z]") & value.rlike("[A-Z]") & (size >= 24)).when(kind == "number", size.between(13, 19) | value.rlike(r"^[0-9]{3,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}$")).otherwise(value.rlike(r"\x20\p{Lu}[^\x20]+\x20\p{Lu}")), (kind == "number") & (date | (size > 19))),
            vote(said, denied),
            vote(assigned | quoted, before.rlike(r"[$€£§]\s*$|(?i)\bv\.?$")),
            vote(company, F.lit(False)),
            vote(various >= 7, (various <= 3) & (kind != "name")),
        ]
        flags = [kind == "secret", kind == "number", kind == "name", size >= 16, is_hex, joined, assigned, quoted, said, denied, company, various >= 7, before.rlike(r"[.!?]\s*$")]
        return F.struct(*[s[f].alias(f) for f in ("start", "rank", "stop", "kind", "value")], F.concat(*[(v + 1).cast("string") for v in votes]).alias("votes"), F.concat(*[F.coalesce(f, F.lit(False)).cast("int").cast("string") for f in flags]).alias("features"))

    return F.transform(proposals, describe)


@dataclass
class Model:
    """``reliability``: for each labeler and class, the probability of the votes -1, 0 and 1. ``weights``: of the features, and the intercept."""

    share: float
    reliability: dict[str, list[list[float]]]
    weights: list[float]


def expectation_maximisation(counts: dict[str, float], rounds: int = 200) -> tuple[float, list[list[list[float]]], dict[str, float]]:
    """From how often each vote pattern (digits 0 to 2) occurs: the share of class 1, each labeler's vote probabilities by class, and class 1's probability by pattern.

    The start counts votes, which also fixes which class is which. No patterns give even odds.
    """
    labelers = len(next(iter(counts), ""))
    total = sum(counts.values())
    belief = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(int(c) - 1 for c in v))) for v in counts}
    share, tables = 0.5, [[[1 / 3] * 3, [1 / 3] * 3] for _ in range(labelers)]
    for _ in range(rounds if total else 0):
        share = (1 + sum(counts[v] * belief[v] for v in counts)) / (2 + total)
        for k in range(labelers):
            for y in (0, 1):
                mass = [1.0, 1.0, 1.0]
                for v, n in counts.items():
                    mass[int(v[k])] += n * (belief[v] if y else 1 - belief[v])
                tables[k][y] = [m / sum(mass) for m in mass]
        change = 0.0
        for v in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(tables[k][1][int(c)] / tables[k][0][int(c)]) for k, c in enumerate(v))
            new = 1 / (1 + math.exp(-max(-30, min(30, odds))))
            change, belief[v] = max(change, abs(new - belief[v])), new
        if change < 1e-7:
            break
    return share, tables, belief


def train_classifier(rows: list[tuple[str, float, float]], rounds: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier from (features, count, mean belief), by gradient steps; the last is the intercept."""
    total = sum(n for _, n, _ in rows)
    weights = [0.0] * (len(FEATURES) + 1)
    points = [([i for i, c in enumerate(f) if c == "1"], n / total, b) for f, n, b in rows if n] if total else []
    for _ in range(rounds if points else 0):
        grads = [ridge * w for w in weights]
        for on, n, b in points:
            z = weights[-1] + sum(weights[i] for i in on)
            d = n * (1 / (1 + math.exp(-max(-30, min(30, z)))) - b)
            for i in on:
                grads[i] += d
            grads[-1] += d
        weights = [w - rate * g for w, g in zip(weights, grads, strict=True)]
    return weights


def candidates(docs: DataFrame, text: str = "text", column: str = "found") -> DataFrame:
    """Add an array of the text's pieces (:func:`pieces`) with ``base`` (their base spans) and ``candidates`` (described proposals), placed within the piece."""
    with_base = F.transform(pieces(F.coalesce(F.col(text), F.lit(""))), lambda p: F.struct(p["at"].alias("at"), p["text"].alias("text"), p["before"].alias("before"), _base(p["text"]).alias("base")))

    def described(all_pieces: Column, company: Column) -> Column:
        proposed = lambda p: _let(_proposals(p["text"], p["base"]), lambda c: _described(p, c, company))
        return F.transform(all_pieces, lambda p: F.struct(*[p[f].alias(f) for f in ("at", "text", "base")], proposed(p).alias("candidates")))

    return docs.withColumn(column, _let(with_base, lambda ps: _let(F.exists(ps, lambda p: F.size(p["base"]) > 0), lambda company: described(ps, company))))


def fit(found: DataFrame, column: str = "found") -> Model:
    """Fit on all documents' candidates (the table of :func:`candidates`)."""
    every = F.flatten(F.transform(column, lambda p: p["candidates"]))
    rows = found.select(F.explode(every).alias("c")).groupBy("c.votes", "c.features").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[str, float] = {}
    for r in sorted(rows):
        counts[r.votes] = counts.get(r.votes, 0) + r.n
    share, tables, belief = expectation_maximisation(counts)
    mass: dict[str, list[float]] = {}
    for r in sorted(rows):
        m = mass.setdefault(r.features, [0.0, 0.0])
        m[0] += r.n
        m[1] += r.n * belief[r.votes]
    weights = train_classifier([(f, n, b / n) for f, (n, b) in sorted(mass.items())])
    return Model(share, dict(zip(LABELERS, tables, strict=False)), weights)


def classify(found: DataFrame, model: Model, threshold: float = 0.5, column: str = "found", redacted: str | None = None) -> DataFrame:
    """Replace ``column`` by ``base`` and ``spans``: base spans and the candidates whose probability is at least ``threshold``, sorted by start and kind; and add the text without them as ``redacted``."""
    cut = math.log(threshold / (1 - threshold))

    def taken(c: Column) -> Column:
        z = F.lit(model.weights[-1])
        for i, w in enumerate(model.weights[:-1]):
            z = z + F.when(F.substring(c["features"], i + 1, 1) == "1", F.lit(w)).otherwise(0.0)
        return z >= cut

    def spans(p: Column) -> Column:
        added = F.transform(F.filter(p["candidates"], taken), lambda c: F.struct(*[c[f].alias(f) for f in ("start", "rank", "stop", "kind", "value")]))
        return F.array_sort(F.concat(p["base"], added))

    judged = found.withColumn(column, F.transform(column, lambda p: F.struct(p["at"].alias("at"), p["text"].alias("text"), p["base"].alias("base"), spans(p).alias("spans"))))
    whole = lambda f: F.flatten(F.transform(column, lambda p: _moved(p[f], p["at"])))
    out = judged.withColumns({"base": whole("base"), "spans": whole("spans")} | ({redacted: F.array_join(F.transform(column, lambda p: redact(p["text"], p["spans"])), "")} if redacted else {}))
    return out.drop(column)


def find_personal_data(docs: DataFrame, text: str = "text", threshold: float = 0.5, redacted: str | None = None) -> DataFrame:
    """Add ``base`` and ``spans`` (arrays of start, rank, stop, kind, value; code points, end exclusive) to ``docs``, and with ``redacted`` a column of that name: the text with each span replaced by its kind in angle brackets.

    Null and empty texts have none, and are redacted to the empty text. The model is fitted on the very documents, so the result is one for the whole table; an empty table
    gives no rows, and repeated rows count as often as they come. Columns of ``docs`` named like an added one are an error.
    """
    if clash := {"base", "spans", redacted} & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    column = "_found"
    while column in docs.columns:
        column = "_" + column
    found = candidates(docs, text, column)
    return classify(found, fit(found, column), threshold, column, redacted)


def redact(text: Column, spans: Column) -> Column:
    """A piece with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        more = F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(F.lit(0), x["start"] - s["at"])), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        inside = x["start"] < s["at"]
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(inside, s["out"]).otherwise(more).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2147483647)))))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

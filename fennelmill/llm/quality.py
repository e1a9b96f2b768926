"""Line-first cleaning: rules judge each line, lines that fail go, and a document that loses too much goes whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.common import SEPARATORS, slices, small_batches

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_WORDS = re.compile(f"[^{SEPARATORS}]+")
#: Words of the windows in which repetition is sought.
WINDOW = 8


#: Phrases of boilerplate in the four languages expected, as alternatives.
BOILERPLATE = (
    r"all rights reserved|copyright (?:\(c\)|©|[0-9]{4})|released under the .{0,40}licen[sc]e|licensed under|privacy policy|terms of (?:use|service)|cookies? (?:policy|settings)|accept (?:all )?cookies|enable javascript"
    r"|click here|sign up (?:now|for)|log ?in to|subscribe to our|skip to (?:main )?content|back to top|lorem ipsum"
    r"|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|impressum und|cookies akzeptieren|hier klicken|newsletter abonnieren|zum inhalt springen|zurück nach oben"
    r"|tous droits réservés|politique de confidentialité|conditions d'utilisation|mentions légales|accepter les cookies|cliquez ici|abonnez-vous à|aller au contenu|retour en haut"
    r"|todos los derechos reservados|política de privacidad|términos y condiciones|aviso legal|aceptar (?:todas )?las cookies|haga clic aquí|suscríbete a|saltar al contenido|volver arriba"
)
#: Words of which menus are separators.
MENU_MARKS = ("|", "||", "»", "›", "·", "•", ">", ">>", "/", "::", "→", "-")
#: What may end a sentence.
TERMINAL = ".!?…:;\"'”’»)]。！？।؟"


@dataclass(frozen=True)
class LineRules:
    """Thresholds and patterns; the defaults are what the query uses."""

    #: A line of this many words or more must end in terminal punctuation, unless it is a document's last, which may be
    #: cut off, or the next line goes on in lower case, as in wrapped prose.
    unpunctuated_words: int = 12
    terminal: str = TERMINAL
    #: Share of words that may end in two or more marks.
    marked_share: float = 0.5
    marks: str = r"[#*$%&|<>!?~^=_]{2,}[.,;:]?$"
    #: Share of separators among the words of a navigation line, and how many it has at least.
    separator_share: float = 0.25
    separators_least: int = 2
    separators: frozenset[str] = frozenset(MENU_MARKS)
    #: So many lines or more in a row, each of so many words at most and without terminal punctuation, are a menu.
    menu_lines: int = 5
    menu_words: int = 3
    #: A line of no more words than these that holds a phrase goes; a longer one only mentions it.
    boilerplate: str = BOILERPLATE
    boilerplate_words: int = 20
    #: Share of a line's words that may equal the word before: stutter counts as boilerplate.
    stutter_share: float = 0.4
    #: Share of a document's non-blank characters that its removed lines may hold.
    loss: float = 0.6


class Judge:
    """The rules, compiled in a worker."""

    def __init__(self, rules: LineRules) -> None:
        self.rules, self.marks = rules, re.compile(rules.marks)
        self.boilerplate = re.compile(rf"(?i)(?:^|\W)(?:{rules.boilerplate})(?:$|\W)")

    def verdicts(self, lines: list[str]) -> list[str | None]:
        """For each line the rule that it fails first, or None."""
        words = [line.strip(SEPARATORS) and _WORDS.findall(line) or [] for line in lines]
        last = max((i for i, w in enumerate(words) if w), default=-1)
        out = [self._verdict(line, words[i], i >= last, lines[i + 1] if i < last else "") for i, line in enumerate(lines)]
        run: list[int] = []
        for i, w in enumerate([*words, None]):
            if w and len(w) <= self.rules.menu_words and w[-1][-1] not in self.rules.terminal:
                run.append(i)
                continue
            if len(run) >= self.rules.menu_lines:
                for k in run:
                    out[k] = out[k] or "navigation"
            run = []
        return out

    def _verdict(self, line: str, words: list[str], last: bool, following: str) -> str | None:
        rules, n = self.rules, len(words)
        if not n:
            return None
        separators = sum(w in rules.separators for w in words)
        if separators >= rules.separators_least and separators >= rules.separator_share * n:
            return "navigation"
        if n >= 3 and sum(map(bool, map(self.marks.search, words))) > rules.marked_share * n:
            return "punctuation"
        if not last and n >= rules.unpunctuated_words and words[-1][-1] not in rules.terminal:
            goes_on = following.lstrip(SEPARATORS)[:1]
            if not (goes_on and category(goes_on) == "Ll"):
                return "punctuation"
        if n >= 5 and sum(a == b for a, b in zip(words, words[1:])) > rules.stutter_share * n:
            return "boilerplate"
        return "boilerplate" if n <= rules.boilerplate_words and self.boilerplate.search(line) else None


def measure(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, lines equal to an earlier one, words in repeated windows)."""
    words = text.encode().split()  # bytes split at exactly the separators of the contract
    chars = len(text) - sum(map(text.count, SEPARATORS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
    repeated = 0
    if len(words) > WINDOW:
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        windows = list(zip(*(ids[k:] for k in range(WINDOW))))
        if len(set(windows)) < len(windows):
            times: dict[tuple, int] = {}
            for w in windows:
                times[w] = times.get(w, 0) + 1
            upto = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def assess(df: DataFrame, rules: LineRules = LineRules(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures, verdict and cleaned text of each row, without a shuffle.

    Returns the id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``
    (fewer than 20 words, or over 30 % of them in repeated windows), ``lines_removed``, ``chars_lost`` and
    ``chars_seen`` (characters of removed and of all lines, without surrounding white space), ``kept`` and ``cleaned``
    (the text without the lines that fail). Words, and white space at the ends of lines, go by the contract's separators.

    Edge cases: a NULL or empty text has zero measures and fails the base rules; a NULL id stays NULL; repeated rows
    give repeated results; other columns are not read, whatever their names; an empty table gives no rows; very long
    texts and lines are judged whole; a loss of exactly the allowed share is kept.
    """
    out = _judged(df, rules, text_column, [id_column])
    return out.select(F.col("c0").alias(id_column), *out.columns[1:])


def clean(df: DataFrame, rules: LineRules = LineRules(), text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`assess` keeps, with cleaned texts and all columns; ``n_chars``, if there, is set anew.

    Edge cases: rows with a NULL or empty text fail the base rules and go; NULLs in other columns and repeated rows stay
    as they are; columns may have any names; an empty table gives no rows; very long texts are judged whole.
    """
    out = _judged(df, rules, text_column, list(df.columns)).where("kept")
    fresh = {text_column: F.col("cleaned")} | ({"n_chars": F.length("cleaned").cast(df.schema["n_chars"].dataType)} if "n_chars" in df.columns else {})
    return out.select(*(fresh.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)))


def _judged(df: DataFrame, rules: LineRules, text_column: str, carried: list[str]) -> DataFrame:
    """Carried columns as ``c0``, ``c1`` and so on, then what the rules say of the text."""
    source = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)), F.col(f"`{text_column}`").cast("string").alias("text"))
    schema = ", ".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carried)))
    small_batches(df.sparkSession)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed", "chars_lost", "chars_seen")

    names = [*(f"c{i}" for i in range(len(carried))), *longs, "base_failed", "kept", "cleaned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules)
        for part in slices(batches, "text"):
            numbers, failed, kept, cleaned = [], [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                measures = measure(text)
                lines = text.split("\n")
                fails = judge.verdicts(lines)
                sizes = [len(line.strip(SEPARATORS)) for line in lines]
                removed, seen = sum(map(bool, fails)), sum(sizes)
                lost = sum(n for n, f in zip(sizes, fails) if f)
                bad = measures[0] < 20 or 100 * measures[4] > 30 * measures[0]
                numbers.append((*measures, removed, lost, seen))
                failed.append(bad)
                kept.append(not bad and lost <= rules.loss * seen)
                cleaned.append("\n".join(line for line, f in zip(lines, fails) if not f) if removed else text)
            columns = [pa.array(x, pa.int64()) for x in zip(*numbers)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns, pa.array(failed), pa.array(kept), pa.array(cleaned, pa.string())], names)

    return source.mapInArrow(run, f"{schema}, {', '.join(f'{x} long' for x in longs)}, base_failed boolean, kept boolean, cleaned string")


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_RULES = LineRules()
#: All of the query in SQL, with the default rules.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
x AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS v, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM l),
y AS (SELECT *, len(v) AS n, length(s) AS size, i >= max(i) FILTER (len(v) > 0) OVER (PARTITION BY doc_id) AS is_last, right(s, 1) IN ({_sql_list(TERMINAL)}) AS ends,
  regexp_matches(coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), ''), '^\p{{Ll}}') AS goes_on FROM x),
m AS (SELECT *, n BETWEEN 1 AND {_RULES.menu_words} AND NOT ends AS tiny, i - row_number() OVER (PARTITION BY doc_id, n BETWEEN 1 AND {_RULES.menu_words} AND NOT ends ORDER BY i) AS run FROM y),
z AS (SELECT *, n > 0 AND ((len(list_filter(v, lambda a: a IN ({_sql_list(MENU_MARKS)}))) >= greatest({_RULES.separators_least}, {_RULES.separator_share}::DOUBLE * n))
  OR (n >= 3 AND len(list_filter(v, lambda a: regexp_matches(a, '{_RULES.marks}'))) > {_RULES.marked_share}::DOUBLE * n)
  OR (NOT is_last AND n >= {_RULES.unpunctuated_words} AND NOT ends AND NOT goes_on)
  OR (n >= 5 AND len(list_filter(range(1, n), lambda a: v[a] = v[a + 1])) > {_RULES.stutter_share}::DOUBLE * n)
  OR (n <= {_RULES.boilerplate_words} AND regexp_matches(line, '(?i)(?:^|[^\pL\pN_])(?:{BOILERPLATE.replace("'", "''")})(?:$|[^\pL\pN_])'))
  OR (tiny AND count(*) OVER (PARTITION BY doc_id, tiny, run) >= {_RULES.menu_lines})) AS fails FROM m),
k AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(*) FILTER (fails) AS lines_removed, CAST(coalesce(sum(size) FILTER (fails), 0) AS BIGINT) AS chars_lost, CAST(sum(size) AS BIGINT) AS chars_seen FROM z GROUP BY 1),
o AS (SELECT w.doc_id, len(ws) AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lines_removed, chars_lost, chars_seen
  FROM w JOIN k USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND chars_lost <= {_RULES.loss}::DOUBLE * chars_seen AS kept FROM o
"""

"""Line-first quality rules, in DataFrame functions only.

Every line of a text is held against three rules: punctuation (too many marks that prose does not use), navigation
(menus and link bars) and boilerplate (notices that sites repeat). Failing lines are removed; a document that loses
more than a share of its text is rejected. The base counts are those of the whole text before any removal.

A null or empty text has no words; it fails the base rules and is not kept. Its cleaned text is empty. Lines without a
word are neither judged nor counted as text. Repeated rows, null ids and ties need nothing special, as each row is
judged by itself in a narrow pass. Very long texts are judged whole; a task holds one at a time, with its words and
lines as arrays. An empty table gives an empty result. Columns named like the results are replaced, others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract.
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50

#: Marks that prose hardly uses, and the share of a line's characters that they may have.
MARKS = "[#*$%&|<>!?^~]"
MOST_MARKS = 0.1
#: A bar has this many separators between its words; a link label has so few words and no full stop.
BAR = "(?:^|\\s)[|»›·•>](?:\\s|$)"
BAR_SEPARATORS = 2
#: Labels of menus and notices that sites repeat, in English, German, French and Spanish.
LABEL = (
    "(?i)^\\s*(?:home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|read more|skip to content|share this|click here"
    "|startseite|anmelden|registrieren|suche|weiter|zurück|nach oben|mehr lesen|weiterlesen|teilen"
    "|accueil|connexion|se connecter|inscription|rechercher|suivant|précédent|haut de page|lire la suite|partager"
    "|inicio|iniciar sesión|registrarse|buscar|siguiente|anterior|volver arriba|leer más|compartir)\\s*$"
)
NOTICE = (
    "(?i)(?:all rights reserved|we use cookies|accept cookies|cookie policy|privacy policy|terms of use|terms of service|enable javascript|lorem ipsum|subscribe to our newsletter"
    "|alle rechte vorbehalten|wir verwenden cookies|datenschutzerklärung|nutzungsbedingungen|newsletter abonnieren"
    "|tous droits réservés|nous utilisons des cookies|politique de confidentialité|conditions d'utilisation|abonnez-vous à notre"
    "|todos los derechos reservados|utilizamos cookies|política de privacidad|condiciones de uso|suscríbete a nuestro)"
)
MOST_LOST = 0.3


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more: sorted windows meet their equals."""

    def count(ws: Column) -> Column:
        n = F.size(ws)
        windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("w"), i.alias("i")))
        return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(windows), found))

    def found(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & (F.get(s, k)["w"] == F.get(s, k - 1)["w"])) | ((k < last) & (F.get(s, k)["w"] == F.get(s, k + 1)["w"])))
        return let(F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"])), covered)

    def covered(d: Column) -> Column:
        """Words under windows that start at the ascending places d; each adds those the one before has not."""
        n = F.size(d)
        rest = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(3), lambda a, k: a + F.least(F.lit(3), F.get(d, k) - F.get(d, k - 1)))
        return F.when(n == 0, F.lit(0)).when(n == 1, F.lit(3)).otherwise(rest)

    return let(words, count).cast("long")


def chars_of(text: Column, pattern: str) -> Column:
    """How many characters match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails one of the three rules."""
    solid = F.length(F.regexp_replace(line, SPACE, ""))
    punctuation = chars_of(line, MARKS) > F.lit(MOST_MARKS) * solid
    navigation = (F.size(F.split(line, BAR, -1)) > BAR_SEPARATORS) | line.rlike(LABEL)
    return punctuation | navigation | line.rlike(NOTICE)


def judged_line(line: Column) -> Column:
    """(line, full, fails): whether a line has a word, and whether it then fails a rule."""
    full = line.rlike("[^\\x20\\x09-\\x0D]")
    return F.struct(line.alias("line"), full.alias("full"), (full & line_fails(line)).alias("fails"))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base counts, the verdict and the cleaned text.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, lost_chars (long),
    base_failed, kept (boolean), cleaned (string). Columns of docs with these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows travel as one struct, so no column of theirs can clash. Each line is judged once: (line, has a word, fails).
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text.alias("_text"))
    split = split.withColumns({"_words": words_of(F.col("_text")), "_lines": F.transform(F.split("_text", "\n", -1), judged_line)})
    solid = lambda x: F.length(F.regexp_replace(x, SPACE, ""))
    marked = split.withColumns({"_full": F.transform(F.filter("_lines", lambda x: x["full"]), lambda x: x["line"]), "_failed": F.transform(F.filter("_lines", lambda x: x["fails"]), lambda x: x["line"])})
    counted = marked.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": chars_of(F.col("_text"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
            "n_lines": F.size("_full").cast("long"),
            "n_failed_lines": F.size("_failed").cast("long"),
            "lost_chars": F.aggregate("_failed", F.lit(0).cast("long"), lambda a, x: a + solid(x)),
            "cleaned": F.when(F.size("_failed") == 0, F.col("_text")).otherwise(F.array_join(F.transform(F.filter("_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")),
        }
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = F.col("lost_chars") <= MOST_LOST * F.col("word_chars")
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars", "cleaned"]
    own = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in (*added, "base_failed", "kept")]
    return counted.select(*own, *added, base.alias("base_failed"), (~base & verdict).alias("kept"))

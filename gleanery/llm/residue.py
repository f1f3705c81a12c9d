"""Template residue, filler and error pages in a corpus of texts.

Messages (sentences and lines outside quotation marks) are mined into templates
by a prefix tree of fixed depth: a message goes to the leaf of its token count
and its first ``DEPTH`` tokens after variable parts (numbers, paths, codes) are
masked. A leaf holds several templates, split by similarity: messages share one
if they agree in every token that a verdict can depend on, and their other tokens
become wildcards. Which tokens those are follows from the patterns themselves
(``signal``), so a template has the verdict of each of its messages, whatever else
is in its leaf, and merging trees is a plain aggregation in any order. Each task
grows the tree of its own rows and shuffles one row for each template; the trees
are merged, each template is judged once, and its verdict goes back to the
documents that hold a message of it. A message without any of the words that
every pattern needs (``cued``, derived from the patterns too) enters no tree.

Unresolved slots and unset values stand inside ordinary sentences, whose
templates say nothing; they are found in the messages themselves.

What stands in quotation marks, or in a sentence that names a template, tag or
placeholder, is written about and does not count.

Defined cases: null, empty and blank texts are never found; repeated rows of a
document count once; long texts are read whole.
"""

from __future__ import annotations

import re
from re import _parser
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import cut, join_counted

#: Tokens of a message that the tree branches on below its token count.
DEPTH = 3
#: Points a document needs: a certain template has 2, one that also ends ordinary pages 1.
LIMIT = 2
#: Words of a message that, nearly all the same, are filler.
REPEATS = 8

# Phrases of error pages, failures and notices, by language.
_ERROR = [
    # English
    r"page (?:was )?not found", r"(?:error|http) ?<num>", r"<num> ?[-–:]? ?(?:not found|forbidden|unauthorized|bad gateway|service unavailable|internal server error|gateway time-?out|too many requests|bad request)",
    r"bad gateway", r"service (?:is )?(?:temporarily )?unavailable", r"internal server error", r"(?:error interno|erreur interne|interner (?:server)?fehler)", r"gateway time-?out", r"access (?:is )?denied", r"^nothing here", r"session (?:has )?(?:timed out|expired)",
    r"this account has been suspended", r"too many requests", r"something went wrong", r"^oops\b", r"that page has gone", r"down for maintenance", r"(?:could not|cannot|can't|error) (?:connect|establish|establishing a connection) to the database",
    r"server did not (?:answer|respond)", r"you (?:have no|do not have|don't have) permission to (?:open|access|view)", r"does not exist on this server", r"the page you (?:asked for|requested|are looking for) (?:was|has been|could|cannot|is)",
    r"our team has been (?:told|notified|informed)", r"check the spelling or use the search", r"please try again (?:in a few|later)", r"an (?:unexpected )?error (?:has )?occurred",
    r"(?:enable|turn on|switch on|activate|allow|requires?) javascript", r"javascript (?:is|must be|has to be) (?:disabled|enabled|required|turned)", r"loads only with scripts", r"(?:scripts|cookies) (?:are|is) (?:blocked|switched off|disabled)", r"allow scripts", r"with scripts switched on",
    r"your browser is (?:too old|out of date|outdated|not supported)", r"checking your browser", r"(?:prove|verify|confirm) that you are (?:not a robot|human)", r"not a robot", r"update your browser", r"complete the (?:captcha|security check)",
    # German
    r"seite (?:wurde )?nicht gefunden", r"fehler <num>", r"dienst nicht verfügbar", r"zugriff verweigert", r"sitzung (?:ist )?abgelaufen", r"seite wurde verschoben", r"auf diesem server unbekannt", r"existiert auf diesem server nicht", r"bitte (?:versuchen sie es )?später (?:erneut|noch einmal|wieder)",
    r"(?:aktivieren|schalten) sie (?:bitte )?javascript", r"javascript (?:aktivieren|einschalten)", r"skripte sind gesperrt", r"ihr browser (?:wird geprüft|ist (?:zu alt|veraltet))", r"(?:wartungsarbeiten|wegen wartung)", r"kein roboter", r"etwas ist schiefgelaufen", r"ein fehler ist aufgetreten", r"^hoppla\b", r"diese seite gibt es nicht",
    # French
    r"page (?:introuvable|non trouvée)", r"erreur <num>", r"(?:service|site) (?:temporairement )?indisponible", r"accès (?:refusé|interdit)", r"session (?:a )?expirée?", r"page demandée a été (?:déplacée|supprimée)", r"n[’']existe pas sur ce serveur", r"réessayez (?:dans|plus tard)",
    r"activer javascript", r"activez javascript", r"scripts sont bloqués", r"vérification de votre navigateur", r"votre navigateur est (?:trop ancien|obsolète)", r"en maintenance", r"pas un robot", r"^oups\b", r"cette page a disparu", r"une erreur (?:est survenue|s[’']est produite)",
    # Spanish
    r"página no (?:encontrada|existe)", r"error <num>", r"servicio no disponible", r"acceso denegado", r"sesión (?:ha )?(?:caducada|caducado|expirada)", r"página fue (?:movida|borrada)", r"no existe en este servidor", r"inténtelo de nuevo", r"vuelva a intentarlo",
    r"active javascript", r"activar javascript", r"scripts están bloqueados", r"comprobando su navegador", r"su navegador es (?:demasiado antiguo|antiguo|obsoleto)", r"en mantenimiento", r"no es un robot", r"^vaya\b.*página", r"algo (?:salió|ha salido) mal", r"esta página (?:ya no existe|ha desaparecido)",
]
# Lines of program failures; no one writes about templates in them.
_FAILURE = [
    r"traceback \(most recent call last\)", r"^file <.*line <num>", r"^(?:[a-z_]\w*\.)*[a-z]\w*(?:error|exception)(?::|$)", r"^at \S+\(\S+:<num>\)", r"(?:fatal|parse|syntax) error:", r"^(?:warning|notice|deprecated): .*\bon line <num>", r"^warning: undefined", r"sql (?:syntax )?error", r"no such table", r"segmentation fault", r"stack trace:", r"exception in thread",
]
# Lines that lead away from error pages but end ordinary pages too.
_AWAY = [r"^(?:go )?back to the (?:front|home) ?page", r"^zur startseite", r"^retour à l[’']accueil", r"^volver al inicio", r"^(?:reference|code|código|referenz|référence|kennung) ?: ?<(?:hex|num)>"]
# Texts that stand until the real ones come.
_FILLER = [
    r"this is sample (?:copy|text)", r"swap it out before launch", r"your text (?:goes )?here", r"insert (?:a |your )?(?:short )?(?:description|text|title|headline)", r"dummy (?:paragraph|text|copy|content)", r"add your first post", r"headline placeholder", r"placeholder (?:text|copy|headline)", r"replace this text", r"just another \w+ site", r"edit this (?:text|paragraph)",
    r"(?:kurze )?beschreibung einfügen", r"hier steht (?:später|bald) ein text", r"blindtext", r"beispieltext", r"platzhaltertext", r"ihr text hier", r"mustertext",
    r"texte de démonstration", r"ajoutez une (?:courte )?description", r"votre texte ici", r"paragraphe factice", r"faux texte", r"texte d[’']exemple",
    r"texto de (?:ejemplo|relleno|muestra)", r"añada una (?:breve )?descripción", r"aquí va su texto", r"párrafo ficticio", r"su texto aquí",
]
#: Words of pseudo-Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum ornare erat tellus massa aptent quorum rutrum tempus proin donec justo mollis semper fusce orci libero lacus quam vario pulvi pulvinar vestibulum curabitur pellentesque maecenas phasellus vivamus aenean nullam integer praesent suspendisse mauris nunc turpis egestas ultrices posuere cubilia sapien ligula porta vitae augue".split()
)
_NOTHING = r"(?:undefined|nan|none|null|nil|\(null\)|\(none\)|\[object object\]|function ?\(\) ?\{ ?\[native code\] ?\})"
#: An unset value alone or after a label; a label has at most five words, a longer one is a sentence.
_UNSET = re.compile(
    rf"^(?:[^\W\d_][\w-]*(?: [\w-]+){{0,4}}\s?: {_NOTHING}|{_NOTHING} \w+(?: \w+){{0,4}} in {_NOTHING}|(?:welcome(?: back)?|hello|hi|dear|hallo|willkommen|bonjour|bienvenue|hola|bienvenido),? {_NOTHING}|(?:posted|written|published) by {_NOTHING}(?: on {_NOTHING})?|{_NOTHING})\W*$",
    re.IGNORECASE,
)
_SLOT = re.compile(
    r"\{\{\{?\s*[\w.$ -]+\s*\}?\}\}|\$\{\s*[\w.-]+\s*\}|#\{\s*[\w.-]+\s*\}|\{\$[\w.-]+\}|\{%-?\s*[\w. \"'=-]+?\s*-?%\}|(?<![\w$#%{@])\{[^\W\d][\w.-]+\}(?![}\w])"
    r"|<%[=-]?\s*[\w.$ ()-]+?\s*-?%>|<\?(?:=|php)\s*\$?[\w.>$ ()-]+;?\s*\?>|%\([\w.-]+\)[sdif]|(?<![\w%])%[^\W\d][\w.-]{2,}%(?!\w)|\[\[[\w. -]+\]\]"
    r"|(?<![\w@])@@[\w.-]+@@(?!\w)|(?<![\w_])__[^\W\d_](?:[\w.-]*[^\W_])?__(?![\w(])|(?<![\w~])~[^\W\d_][\w.-]+~(?!\w)|(?<![\w:])::[^\W\d_][\w.-]+::(?!\w)|(?<![\w#])##[^\W\d_][\w.-]+##(?!\w)"
    r"|\[(?:insert|your|enter|add|einfügen|ihr|ihre|insérer|insérez|votre|insertar|inserte|su)\b(?:[^\].!?\n]|[.!?](?!\s))+\]",
    re.IGNORECASE,
)
_SLOT_SIGN = re.compile(r"[{%\[@~]|__|::|##|<\?")
#: Quotation marks; a slot alone between two of them is written about.
_MARKS = frozenset("\"'`“”„«»‘’")
_ABOUT = re.compile(
    r"\b(?:templates?|tags?|placeholders?|variables?|dummy copy|vorlagen?|platzhalter|gabarits?|modèle de page|balises?|marqueurs?|plantillas?|etiquetas?|marcadores?)\b(?! ?placeholder)", re.IGNORECASE
)
_HEADLINE_FILLER = re.compile(r"\b(?:headline|text|image) placeholder\b", re.IGNORECASE)
_QUOTED = re.compile(r"(?<!\w)\"(?=\S)[^\"\n]*[^\"\s]\"(?!\w)|“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»|`[^`\n]+`|(?<![\w’'])'[^'\n]+'(?!\w)|‘[^‘’\n]+’(?!\w)")
_UNSEEN = re.compile("[\u00ad\u180e\u200b-\u200f\u2060\ufeff]")
_PIECES = re.compile(r"[\r\n]+|(?<=[.!?…])\s+")
_VARIES = re.compile(r"[\d/\"']")
_MASKS = [(re.compile(r"\"[^\"\n]*\"|'[^'\n]*'"), "<str>"), (re.compile(r"(?<!\S)/[\w.-]+(?:/[\w.-]+)*/?"), "<path>"), (re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b"), "<hex>"), (re.compile(r"\d+"), "<num>")]
_JUDGE = re.compile("|".join(_ERROR + _FILLER))
_JUDGE_FAILURE = re.compile("|".join(_FAILURE))
_JUDGE_AWAY = re.compile("|".join(_AWAY))
_WORD = re.compile(r"[^\W\d_]+")
_MASK_NAMES = frozenset(name.strip("<>") for _, name in _MASKS)
#: What stands for a token that no verdict depends on.
ANY = "<*>"


def _literals(parsed) -> list[tuple[str, list]]:
    """Items of a parsed pattern: runs of letters, and alternatives with the items of each, ``must`` or ``may``."""
    out: list[tuple[str, list]] = []
    run = ""
    for op, value in parsed:
        op = str(op)
        letter = chr(value) if op == "LITERAL" else ""
        if letter and _WORD.fullmatch(letter):
            run += letter
            continue
        if run:
            out.append(("must", [[run]]))
            run = ""
        if op == "BRANCH":
            out.append(("must", [_literals(branch) for branch in value[1]]))
        elif op == "SUBPATTERN":
            out.append(("must", [_literals(value[3])]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out.append(("must" if value[0] else "may", [_literals(value[2])]))
    return out + ([("must", [[run]])] if run else [])


def needed(pattern: str) -> set[str]:
    """Pieces of words of which every match of the pattern holds at least one; the longest that can be had."""

    def cover(items: list) -> set[str]:
        best: set[str] = set()
        for item in items:
            if isinstance(item, str):
                here = {item} - _MASK_NAMES
            else:
                parts = [cover(branch) for branch in item[1]] if item[0] == "must" else [set()]
                here = set().union(*parts) if all(parts) else set()
            if here and (not best or min(map(len, here)) >= min(map(len, best))):
                best = here
        return best

    return cover(_literals(_parser.parse(pattern)))


def pieces_of(pattern: str) -> set[str]:
    """Every piece of a word that the pattern names; a single optional letter belongs to the piece before it."""

    def walk(items: list, optional: bool) -> set[str]:
        found: set[str] = set()
        for item in items:
            if isinstance(item, str):
                found |= set() if optional and len(item) == 1 else {item}
            else:
                for branch in item[1]:
                    found |= walk(branch, item[0] == "may")
        return found

    return walk(_literals(_parser.parse(pattern)), False) - _MASK_NAMES


_CUES = frozenset().union(*(needed(p) for p in _ERROR + _FAILURE + _FILLER + _AWAY))
_SIGNALS = frozenset().union(*(pieces_of(p) for p in [*_ERROR, *_FAILURE, *_FILLER, *_AWAY, _ABOUT.pattern, _HEADLINE_FILLER.pattern]))
_SHORT = 2


def _finder(pieces: frozenset[str]):
    """A pattern of the pieces within a word; those of one or two letters must be the word."""
    within = "|".join(sorted(w for w in pieces if len(w) > _SHORT))
    alone = "|".join(sorted(w for w in pieces if len(w) <= _SHORT))
    return re.compile(rf"{within}|(?<![^\W\d_])(?:{alone})(?![^\W\d_])")


_CUE, _SIGNAL = _finder(_CUES), _finder(_SIGNALS)


class _Known(dict):
    """Answers about tokens, remembered; forgetting them changes no answer."""

    def __init__(self, ask):
        self.ask = ask

    def __missing__(self, token: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        self[token] = answer = self.ask(token)
        return answer


_is_cue = _Known(lambda token: bool(_CUE.search(token)))
#: Tokens with a piece that a pattern names, without letters, or with signs inside.
_is_signal = _Known(lambda token: bool(_SIGNAL.search(token)) or not _WORD.search(token) or bool(re.search(r"[<(:]", token)))
_CODE = re.compile(r"^\s*(?:File \"|at [\w.$]+\(|(?:[A-Za-z_]\w*\.)*\w*(?:Error|Exception)\b|SQL|Warning:|Fatal)")


def messages(text: str) -> list[str]:
    """Sentences and lines of a text; quoted spans are left out, but not in lines of program failures.

    Hard spaces count as spaces and invisible characters not at all.
    """
    if "&nbsp;" in text:
        text = text.replace("&nbsp;", " ")
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    out = []
    for line in re.split(r"[\r\n]+", text):
        bare = line if _CODE.match(line) else _QUOTED.sub(" ‹›", line)
        out += [piece for piece in _PIECES.split(bare) if piece and not piece.isspace()]
    return out


def masked(message: str) -> list[str]:
    """Tokens in lower case with variable parts masked."""
    low = message.lower()
    if _VARIES.search(low):
        for pattern, name in _MASKS:
            low = pattern.sub(name, low)
    return low.split()


def cued(words: list[str]) -> bool:
    """Whether a message has a word that some pattern of a verdict needs."""
    return any(map(_is_cue.__getitem__, words))


def template_of(tokens: list[str]) -> str:
    """The template of a masked message: its first tokens and those that a verdict can depend on."""
    return " ".join(t if at < DEPTH or _is_signal[t] else ANY for at, t in enumerate(tokens))


def verdict(template: str) -> int:
    """Points of a template: 2 error, failure, notice or filler; 1 a way out of an error page; 0 else."""
    said = template.replace(ANY, "_")
    if _JUDGE_FAILURE.search(said):
        return 2
    if _ABOUT.search(said) and not _HEADLINE_FILLER.search(said):
        return 0
    return 2 if _JUDGE.search(said) else 1 if _JUDGE_AWAY.search(said) else 0


def open_slots(text: str) -> int:
    """Sentences and lines with an unfilled slot that is neither alone in quotation marks nor written about."""
    if not _SLOT_SIGN.search(text):
        return 0
    found = 0
    for line in re.split(r"[\r\n]+", text):
        if _SLOT_SIGN.search(line) and _SLOT.search(line):
            for piece in _PIECES.split(line):
                slots = [m for m in _SLOT.finditer(piece) if not (piece[max(0, m.start() - 1) : m.start()] in _MARKS and piece[m.end() : m.end() + 1] in _MARKS)]
                found += bool(slots) and not _ABOUT.search(piece)
    return found


def unresolved(message: str, words: list[str]) -> bool:
    """Whether a message of these words is an unset value, pseudo-Latin filler, or one word over and over."""
    if _UNSET.match(message.strip()):
        return True
    if len(words) >= REPEATS and words.count(words[len(words) // 2]) >= 0.9 * len(words):
        return True
    return len(words) >= 4 and sum(w in LATIN for w in words) >= 0.7 * len(words) and sum(w in LATIN and len(w) > 4 for w in words) >= 3


_MINED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("key", pa.binary()), ("template", pa.string()), ("uses", pa.int64()), ("slots", pa.int32())])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tree: dict[str, list] = {}
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            slots, held = open_slots(text), set()
            for message in messages(text):
                words = _WORD.findall(message.lower())
                slots += unresolved(message, words)
                if not cued(words):
                    continue
                tokens = masked(message)
                template = template_of(tokens)
                node = tree.get(template)
                if node is None:
                    key = blake2b(template.encode("utf-8", "replace"), digest_size=16).digest()
                    node = tree[template] = [" ".join([str(len(tokens)), *tokens[:DEPTH]]), key, 0]
                node[2] += 1
                held.add(node[1])
            rows += [(doc_id, None, key, None, None, None) for key in held]
            if slots:
                rows.append((doc_id, None, None, None, None, slots))
        rows += [(None, leaf, key, template, uses, None) for template, (leaf, key, uses) in tree.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows), _MINED)], schema=_MINED) if rows else pa.RecordBatch.from_pylist([], schema=_MINED)


def mined(documents: DataFrame) -> DataFrame:
    """Rows of three kinds: doc_id and key; doc_id and slots; leaf, key, template and uses of one task's tree."""
    source = documents.select("doc_id", "text").filter("doc_id is not null and trim(text) <> ''")
    return cut(source.mapInArrow(_mine, "doc_id long, leaf string, key binary, template string, uses long, slots int"))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = [verdict(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(points, pa.int32())], ["leaf", "key", "template", "uses", "points"])


def _judged(rows: DataFrame) -> DataFrame:
    """leaf, key, template, uses and points of every template of the merged trees."""
    whole = rows.filter("template is not null").groupBy("leaf", "key", "template").agg(F.sum("uses").alias("uses"))
    return whole.mapInArrow(_judge, "leaf string, key binary, template string, uses long, points int")


def templates(rows: DataFrame) -> DataFrame:
    """leaf, template, uses and points of every template."""
    return _judged(rows).drop("key")


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, slots and points of each document that has any of them; a leaf counts once, with its best template."""
    rows = mined(documents)
    bad = cut(_judged(rows).filter("points > 0").select("leaf", "key", "points", "uses"))
    held = rows.filter("key is not null and doc_id is not null").select("doc_id", "key")
    # a template has at least as many uses as documents, so the uses tell which templates are hot
    uses = rows.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("n")).first().n
    by_leaf = join_counted(held, bad, ["key"], "uses", uses).select("doc_id", F.lit(0).alias("slots"), "points", "leaf")
    by_slot = rows.filter("slots is not null").select("doc_id", "slots", F.lit(0).alias("points"), F.lit(None).cast("string").alias("leaf"))
    both = by_leaf.unionByName(by_slot).groupBy("doc_id", "leaf").agg(F.max("slots").alias("slots"), F.max("points").alias("points"))
    return both.groupBy("doc_id").agg(F.max("slots").alias("slots"), F.sum("points").alias("points"))


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents to exclude."""
    return residue(documents).filter((F.col("slots") > 0) | (F.col("points") >= LIMIT)).select("doc_id")

"""Main body of a page by line-block distribution.

Markup is stripped so that every block element ends a line and every container
boundary leaves empty lines, as rendering would. Over the lines runs a sliding
window that sums their text lengths: it surges where the sum rises from nothing
to ``SURGE`` characters or more, and dives where a stretch of ``WINDOW`` empty
lines follows. The lines between a surge and its dive are one text of the page; a
stretch whose windows stay below is a menu, a notice or the like. The main body is
the text with the headline, or else that with the most running text; only a page
without any text has its headline's stretch. In a second step single lines of
furniture (bylines, share prompts, pointers, lines that repeat over the site)
are left out.

Pages whose markup is missing have no empty lines between blocks. There a line
known as furniture of the page frame carries no mass and counts as a stretch of
``WINDOW`` empty lines, so the text dives at menus, teaser headings and legal lines;
the headline opens a block.

Only the reading of markup runs in Python, as an Arrow batch map that turns each
page into a few numbers a line; sums, windows and joins are Spark's. Page texts
are never shuffled.

Defined cases: null, empty and blank texts give no lines; a page without a
headline and without running text has its heaviest block as main body; repeated
rows of a page count once; a title that is null, empty or "No Title" is no headline.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.lines import MIN_SUPPORT, repeated_lines

#: Empty lines that a container boundary leaves, and the width of the sliding window.
WINDOW = 3
#: Characters of a window that make a surge; a stretch that never has them is no text.
SURGE = 40

#: Pages that a worker holds as Python objects at a time; their number changes no result.
PAGES_AT_ONCE = 200

# What bylines, share prompts and pointers say within a text, by language.
_MONTH = (
    r"(?:january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember|"
    r"janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)"
)
_DATE = rf"(?:\d{{1,4}}[-./]\d{{1,2}}[-./]\d{{1,4}}|\d+\.?\s+(?:de\s+)?{_MONTH}(?:\s+(?:de\s+)?\d{{4}})?|{_MONTH}\s+\d+(?:,?\s+\d{{4}})?)"
_NAME = r"[^\W\d_][\w’'-]*(?:\s+[^\W\d_][\w’'-]*){0,3}"
#: The rest of a line without the end of a sentence; dots in numbers, hosts and initials end none.
_REST = r"(?:[^.!?…]|\.(?=\S)|(?<=\b\w)\.)*"
_INLINE = [
    # bylines
    rf"(?:by|von|par|por)\s+{_NAME}(?:\s*[,|·-]\s*{_DATE})?",
    rf"(?:posted|written|published|reviewed|edited) by {_REST}",
    rf"(?:veröffentlicht|geschrieben|verfasst) von {_REST}",
    rf"(?:publié|écrit|rédigé|mis en ligne) par {_REST}",
    rf"(?:publicado|escrito|redactado) por {_REST}",
    rf"(?:updated|last updated|aktualisiert|stand|zuletzt geändert|mis à jour|mise à jour|actualizado|actualizada)\b:?[^\w]*(?:\w+[^\w]+)??{_DATE}{_REST}",
    rf"(?:words|text|texte|texto|wort|worte|mots|palabras|fotos?|photos?)\s?:\s?[^|]+\|{_REST}",
    rf"{_NAME},? (?:staff writer at|contributor at|redaktion|rédaction (?:de|du|d’)|redacción (?:de|del))\b{_REST}",
    # share prompts, after the bylines
    rf"\(?(?:share this (?:page|article|story|post)|share on \w+|auf \w+ teilen|partager sur \w+|compartir en \w+|condividi su \w+|seite teilen|diese seite teilen|partager cette page|partagez cette page|compartir esta página|comparte esta página)\b{_REST}",
    rf"\d+ (?:shares|mal geteilt|partages|veces compartido|compartidos)\b{_REST}",
    r"(?:send to a friend|an freunde senden|envoyer à un ami|enviar a un amigo|tell a friend)\W*",
    rf"(?:tell others about|erzählen sie (?:anderen )?von|erzähl anderen von|sagen sie es weiter|parlez de|parlez-en|faites connaître|cuente a otros|hable a otros|háblele a otros|recomiende)\b{_REST}",
    rf"\W*(?:liked it|gefallen|hat es gefallen|ça vous a plu|cela vous a plu|vous avez aimé|le gustó|te gustó)\s?\?{_REST}",
    # pointers to other pages
    r"(?:more on this|related|see also|read next|read also|read more|you may (?:also )?like|up next|mehr dazu|siehe auch|auch lesen|lesen sie auch|weiterlesen|passend dazu|zum thema|das könnte ihnen gefallen|als nächstes|verwandt"
    r"|à lire(?: aussi)?|voir aussi|lire aussi|sur le même sujet|à découvrir|vous aimerez|en savoir plus|à suivre|véase también|ver también|lea también|más sobre esto|relacionado|le puede gustar|le puede interesar|puede interesarle|siga leyendo|a continuación)\s?:?\s.{3,}",
]
# What the frame of a page says, by language.
_FRAME = [
    r"(?:advertisement|advertising|sponsored|anzeige|werbung|publicité|annonce|sponsorisé|publicidad|anuncio|patrocinado)",
    r"(?:most (?:viewed|read|popular)|related stories|related|recommended for you|read next|load more|back to top|previous · next|follow us|subscribe|newsletter|see also|popular now|comments?(?: \(\d+\))?|log in to reply|leave a comment)",
    r"(?:meistgelesen|meistgesehen|auch lesen|mehr laden|nach oben|zurück · weiter|folgen sie uns|für sie empfohlen|das könnte sie interessieren|kommentare?(?: \(\d+\))?|zum antworten anmelden)",
    r"(?:les plus (?:vus|lus)|à lire aussi|voir plus|haut de page|retour en haut|précédent · suivant|suivez-nous|recommandé pour vous|commentaires?(?: \(\d+\))?|se connecter pour répondre)",
    r"(?:lo más (?:visto|leído)|lea también|cargar más|ver más|subir|volver arriba|anterior · siguiente|síganos|recomendado para usted|comentarios?(?: \(\d+\))?|entrar para responder|entre para responder)",
    r"(?:©|\(c\)|copyright)\s?\d{0,4}.*",
    r"(?:sign in|log in|register|sign up|my account|anmelden|registrieren|mein konto|se connecter|s’inscrire|mon compte|iniciar sesión|registrarse|mi cuenta|accedi|registrati)",
    r"(?:imprint|impressum|mentions légales|aviso legal|terms of use|privacy|datenschutz|confidentialité|privacidad)\s?[·|,].*",
    r"(?:subscribe to|abonnieren sie|s’abonner à|abonnez-vous|suscríbase|suscribirse a)\b.*",
    r"(?:get our letter|unser brief|notre lettre|nuestra carta|leave your address|ihre adresse|laissez votre adresse|deje su dirección)\b.*",
    r"(?:was this helpful\?|war das hilfreich\?|cela vous a-t-il aidé \?|¿le fue útil\?).*",
    rf"(?:in stock at|auf lager in|en stock dans|disponible en) \d+ {_REST}",
    r"(?:join \d+ readers|rejoignez \d+ lecteurs|ya somos \d+ lectores|\d+ leser von)\b.*",
    r"(?:skip to content|zum inhalt|aller au contenu|ir al contenido)",
    r"(?:prices on .+ (?:include|may change)|preise auf .+ können sich ändern|les prix de .+ peuvent changer|los precios de .+ pueden cambiar)\b.*",
    r"(?:some links pay|some links earn).+",
    rf"{_NAME} (?:is not liable for|haftet nicht für|ne répond pas de|no responde del) .+",
    r"(?:no part of|kein nachdruck von|aucune copie de|no se copia) .+",
    rf"{_NAME} (?:stores small files|speichert kleine dateien|garde de petits fichiers|guarda pequeños archivos) .+",
]
# What consent notices offer, anywhere in a line, by language.
_CONSENT = ("accept all", "manage options", "reject everything", "allow / decline", "ok, got it", "keep cookies", "place cookies", "cookies ablehnen", "cookie ablehnen", "alle annehmen", "setzen cookies", "tout accepter", "posons des cookies", "ponemos cookies", "aceptar todo", "rechazar todo", "cookie settings", "cookie-einstellungen", "paramètres des cookies", "ajustes de cookies", "accetta tutt")
#: The first entries of ``_INLINE`` are bylines.
_BYLINES = 8
_EDGE = r"^[\s\W]*"
#: A path of page names.
_TRAIL = re.compile(r"[^>.!?]{2,}(?:\s>\s[^>.!?]{2,})+[.!?]?")
BYLINE = re.compile(_EDGE + "(?:" + "|".join(_INLINE[:_BYLINES]) + r")[\s\W]*$", re.IGNORECASE)
INLINE = re.compile(_EDGE + "(?:" + "|".join(_INLINE) + r")[\s\W]*$", re.IGNORECASE)
FRAME = re.compile(_EDGE + "(?:" + "|".join(_FRAME) + r")[\s\W]*$", re.IGNORECASE)

#: Elements that hold others; the rest of the block elements hold a line.
_HOLDERS = frozenset("div article section nav header footer aside main form fieldset td".split())
_BREAKERS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote tr dd dt br pre ul ol dl table tbody thead body hr figcaption option caption th address".split()) | _HOLDERS
_MARKUP = re.compile(r"<!--.*?-->|<(script|style|noscript|template|head|title)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>|[^<]+|<", re.DOTALL | re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?…][\"”»“’)]?$")
_ORNAMENT = re.compile(r"^[\s»–—•>*|\[(-]+|[\s–—•*|\])-]+$|(?<=[.!?…])\s*»$")
_OPENS, _CLOSES = frozenset("»–—•>*|[(-"), frozenset("–—•*|])-»")
#: Running text signed with a name in place of a last sentence: a notice of the site.
_SIGNED = re.compile(r"[.!?…»“\"”]\s+([^\W\d_][\w’-]*(?:\s[^\W\d_][\w’-]*){0,2})[.!…]*[\s»–•)\]-]*$")


def stripped(markup: str) -> list[tuple[str, int, bool]]:
    """Lines of a page: text, number of the container it stands in, whether it is a first-level heading.

    A holder with nothing but text is itself a line of the holder around it.
    Unclosed paragraphs and items end where the next block element begins.
    """
    lines: list[tuple[str, int, int, bool]] = []
    stack, parent, busy, count = [0], {0: 0}, {0}, 0
    text: list[str] = []
    at, direct, heading = 0, True, False

    def flush() -> None:
        nonlocal text
        said = " ".join(html.unescape("".join(text)).split())
        if said:
            lines.append((said, at, int(direct), heading))
            if not direct:
                busy.add(at)
        text = []

    for m in _MARKUP.finditer(markup):
        name = m.group(3)
        if name is None:
            got = m.group(0)
            if got[:4] != "<!--" and m.group(1) is None:
                text.append(got)
            continue
        name = name.lower()
        if name not in _BREAKERS:
            continue
        flush()
        closing = m.group(2) == "/"
        if name in _HOLDERS:
            if not closing:
                count += 1
                parent[count] = stack[-1]
                busy.add(stack[-1]) if len(stack) > 1 or not direct else None
                stack.append(count)
            elif len(stack) > 1:
                stack.pop()
            at, direct, heading = stack[-1], True, False
        else:
            at, direct, heading = stack[-1], closing or name in ("br", "hr"), name == "h1" and not closing
            if not closing and name not in ("br", "hr"):
                direct = False
    flush()
    out = []
    for said, where, own, top in lines:
        leaf = own and where not in busy
        out.append((said, parent[where] if leaf else where, top))
    return out


def aligned(lines: list[str], parts: list[str]) -> list[int]:
    """For each line the place of its counterpart in ``parts``, in order, or -1.

    Lines that stand once on either side are the anchors; of them the longest run
    in order holds, and between two of them each line takes the next equal part.
    So neither markup that the text does not show nor a line without markup moves the rest.
    """
    if not parts:
        return [-1] * len(lines)
    places: dict[str, list[int]] = {}
    for j, part in enumerate(parts):
        places.setdefault(part, []).append(j)
    seen = Counter(lines)
    tops: list[int] = []
    ends: list[int] = []
    before: dict[int, int] = {}
    for i, line in enumerate(lines):
        if seen[line] == 1 and len(places.get(line, ())) == 1:
            j = places[line][0]
            at = bisect_left(tops, j)
            before[i] = ends[at - 1] if at else -1
            tops[at : at + 1] = [j]
            ends[at : at + 1] = [i]
    out = [-1] * len(lines)
    i = ends[-1] if ends else -1
    while i >= 0:
        out[i] = places[lines[i]][0]
        i = before[i]
    limit, bounds = len(parts), [0] * len(lines)
    for i in range(len(lines) - 1, -1, -1):
        bounds[i] = limit
        limit = out[i] if out[i] >= 0 else limit
    last = -1
    for i, line in enumerate(lines):
        if out[i] < 0 and line in places:
            of = places[line]
            at = bisect_right(of, last)
            out[i] = of[at] if at < len(of) and of[at] < bounds[i] else -1
        last = max(last, out[i])
    return out


def line_kind(line: str) -> int:
    """1: furniture that stands within texts (bylines, prompts, pointers); 2: of the page frame; 0: neither."""
    low = line.lower()
    if FRAME.match(line) or (" > " in line and _TRAIL.fullmatch(line)) or any(offer in low for offer in _CONSENT):
        return 2
    return 1 if INLINE.match(line) else 0


def page_lines(title: str | None, text: str, markup: str | None, kinds: dict[str, int]) -> list[tuple[int, int, int, int, bool, bool]]:
    """line_no, container (-1 without markup), kind, length without spaces, is headline, is running text of each non-blank line.

    ``kinds`` remembers the kinds of short lines between pages.
    """
    rows = [(no, " ".join(line.split())) for no, line in enumerate(text.split("\n"), 1)]
    rows = [(no, line) for no, line in rows if line]
    parts = stripped(markup) if markup else []
    headline = " ".join((title or "").split())
    if headline == "No Title":
        headline = ""
    out, seen = [], False
    matched = aligned([line for _, line in rows], [part[0] for part in parts])
    for (no, line), j in zip(rows, matched):
        where, top = (parts[j][1], parts[j][2]) if j >= 0 else (-1, False)
        head = not seen and (top or line == headline)
        seen = seen or head
        bare = _ORNAMENT.sub("", line) if line[0] in _OPENS or line[-1] in _CLOSES else line
        prose = bool(_SENTENCE.search(bare)) and bare.count(" ") >= 4
        kind = kinds.get(line)
        if kind is None:
            kind = line_kind(line)
            if len(line) <= 60 and len(kinds) < 20_000:
                kinds[line] = kind
        if not kind and not head and prose and _SIGNED.search(bare):
            kind = 1
        out.append((no, where, kind, len(line) - line.count(" "), head, prose))
    if not seen and not parts:
        # a headline without a title to tell it by: the line that a byline follows
        for i in range(len(out) - 1):
            no, where, kind, length, _, prose = out[i]
            if kind == 0 and not prose and out[i + 1][2] == 1 and BYLINE.match(rows[i + 1][1]):
                out[i] = (no, where, kind, length, True, prose)
                break
    return out


_FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("line_no", pa.int32()), ("container", pa.int32()), ("kind", pa.int32()), ("length", pa.int32()), ("headline", pa.bool_()), ("prose", pa.bool_())]
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds: dict[str, int] = {}
    for whole in batches:
        for start in range(0, whole.num_rows, PAGES_AT_ONCE):
            batch = whole.slice(start, PAGES_AT_ONCE)
            columns: list[list] = [[] for _ in _FEATURES]
            for doc_id, title, text, markup in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for row in page_lines(title, text, markup, kinds):
                    columns[0].append(doc_id)
                    for values, value in zip(columns[1:], row):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _FEATURES)], schema=_FEATURES)


def line_features(pages: DataFrame) -> DataFrame:
    """One narrow row for each non-blank line of each page."""
    source = pages.select("doc_id", "title", "content_text", "html_text").filter("content_text is not null and doc_id is not null")
    return source.mapInArrow(_features, "doc_id long, line_no int, container int, kind int, length int, headline boolean, prose boolean")


def line_blocks(pages: DataFrame, profile: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id, line_no, kind, length, prose, repeated, block and main of each non-blank line.

    ``block`` numbers the stretches between surge and dive of a page; ``main``
    tells the lines of the main body.
    """
    repeated = repeated_lines(pages, profile, min_support).groupBy("doc_id").agg(F.collect_set("line_no").alias("_repeated"))
    once = line_features(pages).repartition("doc_id").dropDuplicates(["doc_id", "line_no"])
    lines = once.join(repeated, "doc_id", "left").withColumn("repeated", F.coalesce(F.array_contains("_repeated", F.col("line_no")), F.lit(False)))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    frame = (F.col("kind") == 2) | (F.col("repeated") & (F.col("kind") == 0) & ~F.col("headline"))
    marked = lines.withColumn("_frame", frame & (F.col("container") < 0))
    opened = F.col("headline") & (F.col("container") < 0)
    boundary = (F.col("container") != F.lag("container").over(order)) | F.col("_frame") | F.lag("_frame").over(order) | opened
    empty = F.when(boundary, WINDOW).otherwise(0)
    placed = marked.withColumn("_empty", F.coalesce(empty, F.lit(0))).withColumn("_mass", F.when(F.col("_frame"), 0).otherwise(F.col("length") + 1))
    placed = placed.withColumn("_at", F.row_number().over(order) + F.sum("_empty").over(order))
    window = Window.partitionBy("doc_id").orderBy("_at").rangeBetween(-WINDOW, -1)
    surge = (F.coalesce(F.sum("_mass").over(window), F.lit(0)) == 0).cast("int")
    # the empty lines between two stretches keep the windows of one from reaching into the other
    ahead = Window.partitionBy("doc_id").orderBy("_at").rangeBetween(0, WINDOW - 1)
    blocks = placed.withColumns({"_surge": surge, "_sum": F.sum("_mass").over(ahead)}).withColumn("block", F.sum("_surge").over(order))
    whole = Window.partitionBy("doc_id", "block")
    weight = F.struct(
        (F.max("_sum").over(whole) >= SURGE).cast("int").alias("text"),
        F.max(F.col("headline").cast("int")).over(whole).alias("headline"),
        F.sum(F.when(F.col("prose") & ~F.col("repeated"), F.col("length")).otherwise(0)).over(whole).alias("prose"),
        F.sum("_mass").over(whole).alias("mass"),
        (-F.col("block")).alias("first"),
    )
    chosen = blocks.withColumn("_weight", weight).withColumn("_best", F.max("_weight").over(Window.partitionBy("doc_id")))
    main = (F.col("_weight") == F.col("_best")) & ((F.col("kind") == 0) | F.col("headline")) & ~F.col("repeated")
    return chosen.select("doc_id", "line_no", "kind", "length", "headline", "prose", "repeated", "block", main.alias("main"))


def not_main_lines(pages: DataFrame, profile: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id and line_no of the non-blank lines outside the main body."""
    return line_blocks(pages, profile, min_support).filter(~F.col("main")).select("doc_id", "line_no")


def main_text(pages: DataFrame, profile: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """doc_id and main_text of each page that has a text; '' if no line is main content."""
    keep = line_blocks(pages, profile, min_support).filter("main").groupBy("doc_id").agg(F.collect_set("line_no").alias("_keep"))
    one = pages.select("doc_id", "content_text").filter("content_text is not null").dropDuplicates(["doc_id"]).join(keep, "doc_id", "left")
    numbered = F.transform(F.split("content_text", r"\r?\n"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    kept = F.filter(numbered, lambda x: F.coalesce(F.array_contains(F.col("_keep"), x["no"]), F.lit(False)))
    return one.select("doc_id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("main_text"))

"""Prompt–answer pairs of all exports, and the defect of each broken pair.

Method. Pairs come from neighbours in time (chats) or line order (sessions). One pass applies the copy, refusal and
language rules and looks at how the answer ends. Answers without a sentence end are then range-sorted by text together
with all answers that begin like one of them, and each is compared with the next larger distinct text: a proper prefix
of it is a shortened version. A histogram of the lengths of different answers shows length-limit spikes: an answer of
such a length without a sentence end was cut there. What neither shows is truncated if its end breaks off.

Defects, the first that holds: ``empty``, ``refusal``, ``copy``, ``language``, ``truncated``.

Defined results: a null or blank prompt makes no pair; a null, blank or empty answer is ``empty``; repeated
rows count once; conversations without id and messages without an instant take no part in the order; empty
tables give an empty result; texts are always judged whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convograph.llm.conversations import ASSISTANT, USER
from convograph.operators.runs import in_runs
from convograph.session import cut, only, parallelism
from convograph.sources.exports import (
    CHATGPT, CLAUDE, GEMINI, SESSIONS, account_zones, chatgpt_messages, claude_messages, newest, session_rows, table, with_instants,
)

# ---------------------------------------------------------------- fixed values
#: function words per language
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was be this that it for on with as by from each our your you we they not can how what why does do if when which into than should would could will there here has have me my i give about at",
    "de": "der die das den dem des ein eine einen einer und oder zu ist sind war wird werden nicht mit auf für von im in wie was warum kann ich wir man sie es dass wenn weil aber auch noch nur diesen dieser dieses jeden unseren unser bei nach vor aus erkläre mir bitte besser am sobald",
    "es": "el la los las un una unos y o de del que en es son fue no con por para como cómo qué porque puedo puede se su este esta cada nuestro nuestra lo al pero más también si cuando conviene ayer antes mejor explícame sin sobre hay",
    "fr": "le la les un une des et ou de du que en est sont pas avec pour par comment quoi pourquoi peut je nous on se ce cette ces chaque notre votre il elle dans mais plus aussi si quand au aux sur avant mieux suffit où puis être ne qui",
    "it": "il lo gli una di del della che è sono non con per come perché posso ogni questo questa nostro ma più anche quando nel alla",
    "pt": "o os um uma do da dos das que é são não com por para como porque posso cada este esta nosso mas mais também quando no na ao",
    "nl": "de het een en of van te is zijn niet met op voor hoe wat waarom kan ik wij dat als omdat maar ook nog deze dit elke onze bij naar uit",
}
#: names by which a prompt asks for a language
LANGUAGE_NAMES = (
    r"english|german|spanish|french|japanese|chinese|korean|italian|portuguese|dutch|russian|"
    r"englisch|deutsch|spanisch|französisch|japanisch|inglés|alemán|español|francés|japonés|"
    r"anglais|allemand|espagnol|français|japonais|英語|ドイツ語|スペイン語|フランス語|日本語"
)
ASKS_LANGUAGE = re.compile(rf"(?i)\b(?:translat|übersetz|traduc|tradui|traduz)|(?:{LANGUAGE_NAMES})|訳")
SCRIPTS = (
    ("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯]")), ("zh", re.compile("[一-鿿]")),
    ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽ]")),
)
#: openings of refusals; each must start the answer
REFUSALS = re.compile(
    r"(?:i(?:['’]?m| am) (?:so |very |really )?(?:sorry|afraid)\b[^.!?\n]{0,40}?\b(?:can(?:no|['’])t|could(?: not|n['’]t)|unable|won['’]t|not able)\b"
    r"|(?:i(?:['’]?m| am)|as an? (?:ai|artificial|language|assistant)\b[^.!?\n]{0,40}?) (?:unable|not able|not permitted|not allowed) to (?:fulfil|help|assist|provide|comply|answer|discuss|share|do|continue|give|support)"
    r"|as an? (?:ai|artificial|language model|assistant)\b[^.!?\n]{0,40}?\b(?:can(?:no|['’])t|must not|won['’]t|will not)\b"
    r"|(?:this|that|your) (?:request|question) (?:goes against|violates|is against)\b"
    r"|(?:sorry|apologies|my apologies)\b[^.!?\n]{0,40}?\b(?:not permitted|not allowed|can(?:no|['’])t (?:help|assist|discuss|answer|do|share|provide)|have to pass|must decline|unable to (?:help|assist|answer))"
    r"|it (?:wouldn['’]t|would not|isn['’]t|is not) (?:be )?appropriate for me\b"
    r"|i (?:can(?:no|['’])t|can not|won['’]t|will not|am not going to) (?:(?:be able to )?(?:assist|help|comply|fulfil|support|discuss|share|provide|engage)\b)(?: you)?(?: (?:with|on|in|that|this|any|about)\b|[.,!]|\s*$)"
    r"|i (?:must|have to|need to) (?:respectfully )?(?:decline|refuse|pass)\b"
    r"|i (?:don['’]t|do not) feel comfortable\b|i(?:['’]?m| am) not comfortable\b"
    r"|unfortunately,? i (?:won['’]t|will not|can(?:no|['’])t|am not|am unable|['’]m not)[^.!?\n]{0,25}\b(?:share|help|assist|provide|discuss|answer|comply|fulfil)\b"
    r"|(?:dabei|damit|das|hierbei) (?:kann|darf) ich (?:leider )?(?:ihnen |dir )?nicht|(?:leider|es tut mir leid)[^.!?\n]{0,30}\b(?:nicht helfen|nicht beantworten)"
    r"|(?:lo siento[^.!?\n]{0,15})?no puedo (?:ayudar|asistir|responder)\w*|(?:désolé[^.!?\n]{0,15})?je ne (?:peux|puis) pas (?:vous |t['’])?(?:aider|répondre)"
    r"|申し訳[^。\n]{0,30}(?:できません|できかねます)|(?:それ|その)[^。\n]{0,20}お手伝いできません)",
    re.I,
)
#: dressings put around a repeated question
DRESSING = re.compile(r"(?i)^\s*(?:you asked|your question(?: was)?|question|q|prompt|prompted|user|re)\s*[:：-]\s*")
PROMPTED = re.compile(r"^\s*Prompted\s+")
#: last lines that are complete without a full stop
REFERENCE_LINE = re.compile(r"(?i)^(?:see|see also|source|sources|more|cf\.?|related|link|links|ref|author|tel|contact|reply-to|attachments?)\b.{0,80}$")
COMPLETE_TAIL = re.compile(
    r"(?:[^\w\s,;:<(\[{/\\=&+-]|\S+@\S+|[\w.-]+\.(?:com|net|org|test|invalid|example)|\S*\d\S*)$"
)
OPEN_WORDS = set(FUNCTION_WORDS["en"].split()) - {"it", "me", "here", "there", "this", "that", "do", "does", "i", "you", "we", "they", "on", "in", "my"} | {
    "my", "this", "that", "because", "although", "while", "since", "after", "near", "within", "during", "between"
}
_WORD = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"(?m)^\s*(?:```|~~~)")
_TAGS = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*>")


def html_text(source: str) -> tuple[str, bool]:
    """Readable text of an HTML answer, and whether its markup breaks off."""
    open_at_end, depth = bool(re.search(r"<[^<>]*$|&[a-zA-Z#0-9]{0,8}$", source)), {}

    def tag(m: re.Match) -> str:
        name = m[2].lower()
        if name in ("p", "li", "ul", "ol", "pre", "code", "div", "table", "strong", "em"):
            depth[name] = depth.get(name, 0) + (-1 if m[1] else 1)
        if name == "li":
            return "" if m[1] else "\n- "
        if name in ("p", "br", "div", "ul", "ol", "pre", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6"):
            return "\n```\n" if name == "pre" else "\n"
        return ""

    text = _TAGS.sub(tag, source)
    text = html.unescape(re.sub(r"<[^<>]*$", "", text)).strip()
    return text, open_at_end or any(v > 0 for v in depth.values())


def language(text: str) -> str | None:
    """Language of a text by script and function words; None where the evidence is thin."""
    body = re.sub(r"(?s)```.*?(?:```|$)|`[^`\n]*`|https?://\S+", " ", text)
    if not body.isascii():
        letters = len(re.findall(r"[^\W\d_]", body))
        for lang, script in SCRIPTS:
            if letters and len(script.findall(body)) > 0.2 * letters:
                return lang
    words = _WORD.findall(body.lower())
    hits = dict.fromkeys(FUNCTION_WORDS, 0)
    for langs in filter(None, map(_LANGUAGES_OF.get, words)):
        for lang in langs:
            hits[lang] += 1
    order = sorted(hits, key=hits.get, reverse=True)
    best, second = hits[order[0]], hits[order[1]]
    if order[0] == "en" and best >= 2 and best > 1.5 * second or best >= 2 and best >= second + 1 and best >= 0.12 * len(words):
        return order[0]
    return None


_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _LANGUAGES_OF[_w] = (*_LANGUAGES_OF.get(_w, ()), _lang)


def is_copy(prompt: list[str], answer: list[str]) -> bool:
    """The answer's words are the question's, once or several times over."""
    n = len(prompt)
    return bool(n) and len(answer) >= n and len(answer) % n == 0 and answer == prompt * (len(answer) // n)


def ending(text: str) -> tuple[bool, bool]:
    """Whether the text breaks off, and whether its end lacks a sentence end at all."""
    if len(_FENCE.findall(text)) % 2:
        return True, True
    line = text.rstrip().rsplit("\n", 1)[-1].strip()
    if re.match(r"(?:```|~~~)", line):
        return False, False
    if line.startswith("|"):
        return not line.endswith("|"), not line.endswith("|")
    if line and COMPLETE_TAIL.search(line.rsplit(None, 1)[-1]):  # its alternatives lie within one stretch
        return False, False
    if line.endswith((",", ";", "(", "[", "{", "=", "<", "&")):
        return True, True
    if re.match(r"\d+[.)](?: |$)", line):
        return True, True
    words = _WORD.findall(line)
    if re.match(r"[-*•+](?: |$)", line):
        return not words or words[-1].lower() in OPEN_WORDS, True
    if REFERENCE_LINE.match(line) and not re.search(r"[.!?] ", line) and words[-1].lower() not in OPEN_WORDS - {"on"}:
        return len(words) < 4 and line.lower().startswith("see"), True
    if re.search(r"(?:author:|by|contact:|ask|dear|regards,?) (?:[A-Z][\w'-]+,? ){1,3}[A-Z][\w'-]+$", line):
        return False, True
    if not words or "\n" not in text.strip() and all(w.isascii() and w.lower() not in _LANGUAGES_OF for w in words):
        return False, True  # a name or other bare phrase: no clause that could break off
    return True, True


def judge(prompt: str, answer: str, is_html: bool) -> tuple[str | None, str, bool]:
    """(defect by the pair's own rules, readable answer, lacks a sentence end)."""
    broken = False
    if is_html:
        prompt = PROMPTED.sub("", prompt)
        answer, broken = html_text(answer)
    answer = answer.strip()
    words = _WORD.findall(answer.lower())
    if not words:
        return "empty", answer, False
    if REFUSALS.match(answer.lstrip("\"'“*_> ")):
        return "refusal", answer, False
    asked = _WORD.findall(prompt.lower())
    if len(words) % max(1, len(asked)) == 0 and is_copy(asked, words) or len(words) < 3 * len(asked) + 12 and is_copy(asked, _WORD.findall(DRESSING.sub("", answer).lower())):
        return "copy", answer, False
    if (a := language(answer)) and (p := language(prompt)) and a != p and not ASKS_LANGUAGE.search(prompt):
        return "language", answer, False
    off, bare = ending(answer)
    return ("truncated" if off or broken else None), answer, bare or broken


def with_previous(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Slim rows with ``before``: the row ahead of each in its group's order, also across partitions."""
    cols = rows.columns
    runs = in_runs(rows, key, order)
    last = runs.groupBy(*key, "run").agg(F.max_by(F.struct(*cols), "pos").alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*key).orderBy("run"))).where(F.col("_carry").isNotNull())
    return runs.join(carry.select(*key, "run", "_carry"), [*key, "run"], "left").withColumn("before", F.coalesce("before", "_carry")).select(*cols, "before")


def prompt_answer_pairs(spark: SparkSession, where: str) -> DataFrame:
    """``tab, rec_id, prompt, answer, is_html`` of every pair with a non-blank prompt; named by its answer.

    Which row of a message counts, and the order, are found on rows without text; texts join once, by row.
    """
    zones = account_zones(spark, where)
    chats = chatgpt_messages(table(spark, where, CHATGPT)).unionByName(claude_messages(table(spark, where, CLAUDE))).where(F.col("rec_id").isNotNull())
    slim = ["tab", "rec_id", "conv_id", "export_id", "row_id", "speaker", "is_text", "account_id", "t_num", "t_text"]
    counts = newest(chats.select(slim), ["tab", "rec_id"], ["export_id", "row_id"])
    counts = counts.where(F.col("conv_id").isNotNull() & F.col("speaker").isin(USER, ASSISTANT) & F.col("is_text"))
    lines = session_rows(table(spark, where, SESSIONS)).where(F.col("kind").isin(USER, ASSISTANT) & F.col("line_id").isNotNull() & F.col("path").isNotNull())
    lines = lines.select(F.lit(SESSIONS).alias("tab"), F.col("line_id").cast("string").alias("rec_id"), F.col("line_id").cast("long").alias("row_id"), "path", F.col("line_no").cast("long").alias("at"), F.col("kind").alias("speaker"), "text")
    turns = (
        with_instants(counts, zones)
        .where(F.col("utc_us").isNotNull())
        .select("tab", F.col("conv_id").alias("grp"), F.col("utc_us").alias("at"), "rec_id", "row_id", "speaker")
        .unionByName(lines.select("tab", F.col("path").alias("grp"), "at", "rec_id", "row_id", "speaker").distinct())
    )
    ordered = with_previous(turns, ["tab", "grp"], ["at", "rec_id"])
    pairs = ordered.where((F.col("speaker") == ASSISTANT) & (F.col("before.speaker") == USER))
    ends = F.array(F.struct("rec_id", "row_id", F.lit(False).alias("asks")), F.struct(F.col("before.rec_id").alias("rec_id"), F.col("before.row_id").alias("row_id"), F.lit(True).alias("asks")))
    parts = pairs.select("tab", F.col("rec_id").alias("pair"), F.inline(ends))
    texts = chats.select("tab", "rec_id", F.col("row_id").cast("long").alias("row_id"), "text").unionByName(lines.select("tab", "rec_id", "row_id", "text"))
    spoken = (
        texts.join(parts.withColumn("row_id", F.col("row_id").cast("long")), ["tab", "rec_id", "row_id"])
        .select("tab", F.col("pair").alias("rec_id"), "asks", "text")
        .repartition(parallelism(spark), "tab", "rec_id")  # kept apart for the Python work that follows
        .groupBy("tab", "rec_id")
        .agg(F.max(F.when(F.col("asks"), F.col("text"))).alias("prompt"), F.max(F.when(~F.col("asks"), F.col("text"))).alias("answer"))
        .withColumn("is_html", F.lit(False))
    )
    item = table(spark, where, GEMINI).where(F.col("item_id").isNotNull()).select(
        F.lit(GEMINI).alias("tab"), F.col("item_id").cast("string").alias("rec_id"), F.col("title").alias("prompt"),
        F.coalesce(F.array_join(F.transform("safe_html_item", lambda x: x["html"]), ""), F.lit("")).alias("answer"),
    )
    items = newest(item.repartition(parallelism(spark), "tab", "rec_id"), ["tab", "rec_id"], ["answer", "prompt"]).withColumn("is_html", F.lit(True))
    return spoken.unionByName(items).where(F.col("prompt").rlike(r"(?U)\S"))


_JUDGED = "tab string, rec_id string, defect string, open boolean, size int, same long, begins array<long>, answer string"


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def beginnings(text: str, only_longest: bool) -> list[int]:
    """Hashes of a text's beginnings of 1, 2, 4, 8 … characters, or of the longest of them.

    A longer version of a text has the text's longest beginning among its own.
    """
    levels = range(len(text).bit_length())
    return [_hash(text[: 1 << k]) ^ k for k in (levels[-1:] if only_longest else levels)]


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges pairs by their own rules; an answer that says something and has no sentence end is open."""
    for pdf in batches:
        out = []
        for tab, rec, prompt, answer, is_html in zip(pdf.tab, pdf.rec_id, pdf.prompt, pdf.answer, pdf.is_html):
            defect, text, bare = judge(prompt, answer, is_html)
            if defect in (None, "truncated"):
                out.append((tab, rec, defect, bare, len(text), _hash(text), beginnings(text, bare), text))
            else:
                out.append((tab, rec, defect, False, len(text), None, None, None))
        yield pd.DataFrame(out, columns=["tab", "rec_id", "defect", "open", "size", "same", "begins", "answer"]).astype({"same": "Int64"})


def may_continue(rows: DataFrame) -> DataFrame:
    """``tab, rec_id, answer, open`` of the rows (with ``begins``) that are open or begin like an open one: no shortened version is lost."""
    keys = cut(rows.where("open").select(F.explode("begins").alias("key")).distinct())
    begin = rows.where("NOT open").select("tab", "rec_id", F.explode("begins").alias("key"))
    name = F.concat_ws(" ", "tab", "rec_id").alias("id")
    ids = cut(only(begin, keys, "key").select(name).distinct())
    columns = ["tab", "rec_id", "answer", "open"]
    longer = only(rows.where("NOT open").select(*columns, name), ids, "id").select(columns)
    return rows.where("open").select(columns).unionByName(longer)


#: rows with a ``rec_id`` are open answers; one without per partition holds its first text, its last, and the next larger than the last
_SORTED = "tab string, rec_id string, short boolean, part int, edge boolean, ends array<string>"


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares answers that come in descending order with the next larger one, which is the text ahead."""
    part, first, larger, current = TaskContext.get().partitionId(), None, None, None
    columns = ["tab", "rec_id", "short", "part", "edge", "ends"]
    for pdf in batches:
        out = []
        for tab, rec, answer, is_open in zip(pdf.tab, pdf.rec_id, pdf.answer, pdf.open):
            if answer != current:
                larger, current = current, answer
                first = answer if first is None else first
            if is_open:  # the largest text of a partition meets its next larger in a partition before
                out.append((tab, rec, larger is not None and larger.startswith(answer), part, larger is None, None))
        yield pd.DataFrame(out, columns=columns)
    if current is not None:
        yield pd.DataFrame([(None, None, False, part, False, [first, current, larger])], columns=columns)


def shortened(rows: DataFrame) -> DataFrame:
    """``tab, rec_id`` of the open answers (``tab, rec_id, answer, open, begins``) of which another answer is a continuation."""
    spread = may_continue(rows).repartitionByRange(parallelism(rows.sparkSession), F.col("answer").desc(), F.col("tab"), F.col("rec_id"))
    found = cut(spread.sortWithinPartitions(F.col("answer").desc(), "tab", "rec_id").mapInPandas(_neighbours, _SORTED))
    # The next larger text of a partition's first one may lie several partitions before, where copies of one
    # answer fill them. It is the last text of a partition, or the next larger than such a last text: three
    # texts per partition are ordered, not pairs.
    ends = found.where(F.col("rec_id").isNull()).select("part", "ends")
    texts = ends.select(F.explode("ends").alias("first")).where(F.col("first").isNotNull()).distinct()
    ahead = texts.withColumn("ahead", F.lead("first").over(Window.orderBy("first")))
    cuts = ends.withColumn("first", F.col("ends")[0]).join(ahead, "first").select("part", F.coalesce(F.col("ahead").startswith(F.col("first")), F.lit(False)).alias("cuts"))
    told = found.where(F.col("rec_id").isNotNull()).join(F.broadcast(cuts), "part", "left")  # a number and a flag per partition
    return told.where(F.col("short") | (F.col("edge") & F.coalesce("cuts", F.lit(False)))).select("tab", "rec_id")


def length_spikes(answers: DataFrame, span: int = 12, factor: float = 6.0) -> DataFrame:
    """Lengths that far more different answers (``size, same``, a hash) have than the ``2 * span`` lengths around (a limit cuts many there).

    A spike has more than ``mean + factor * sqrt(mean + 1) + 8`` answers, where mean is over the lengths
    around it. The histogram has one row per length, so the self-join is over lengths, not answers.
    """
    hist = answers.select("size", "same").distinct().groupBy("size").agg(F.count("*").alias("n"))
    near = hist.select((F.explode(F.sequence(F.col("size") - span, F.col("size") + span))).alias("at"), F.col("size").alias("from"), "n")
    around = near.where(F.col("at") != F.col("from")).groupBy(F.col("at").alias("size")).agg((F.sum("n") / (2 * span)).alias("mean"))
    found = hist.join(around, "size", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    return found.where(F.col("n") > F.col("mean") + factor * F.sqrt(F.col("mean") + 1) + 8).select("size", F.lit(True).alias("spike"))


def judged_pairs(pairs: DataFrame) -> DataFrame:
    """``tab, rec_id, defect, evidence`` of the defective pairs of :func:`prompt_answer_pairs`.

    ``evidence`` of a truncated answer: ``shortened`` (another answer continues it), ``limit`` (it has the length at
    which many are cut), else ``ending`` (how it ends).
    """
    told = pairs.select("tab", "rec_id", "prompt", F.coalesce("answer", F.lit("")).alias("answer"), "is_html")
    rows = cut(told.mapInPandas(_judge, _JUDGED))
    says = rows.where("same IS NOT NULL")
    short = shortened(says).withColumn("short", F.lit(True))
    spikes = length_spikes(says)
    every = rows.drop("answer", "begins").join(short, ["tab", "rec_id"], "left").join(spikes, "size", "left")
    cut_off = F.when(~F.col("open"), None).when(F.col("short"), "shortened").when(F.col("spike"), "limit")
    evidence = F.when(F.col("defect").isNull() | (F.col("defect") == "truncated"), F.coalesce(cut_off, F.when(F.col("defect") == "truncated", "ending")))
    found = every.withColumn("evidence", evidence).withColumn("defect", F.when(F.col("evidence").isNotNull(), "truncated").otherwise(F.col("defect")))
    return found.where(F.col("defect").isNotNull()).select("tab", "rec_id", "defect", "evidence").distinct()


def defects(pairs: DataFrame) -> DataFrame:
    """``tab, rec_id, defect`` of the defective pairs."""
    return judged_pairs(pairs).drop("evidence")

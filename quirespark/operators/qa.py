"""Preparation and evaluation of model questions: history windows, prompts, routing, image references and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.text import numeral, strip, truncate

#: Limits in characters and turns.
SUMMARY_CHARS, QA_CHARS, CONTEXT_CHARS, PROMPT_TURNS, KEPT_TURNS = 8000, 6000, 200, 3, 10
#: The yes of a router's reply; how a question names an image by number, in order; words that ask for any image.
YES = "是"
NUMBERED = (r"第([一二三四五六七八九十\d]+)[张个幅]?图", r"图([一二三四五六七八九十\d]+)", r"第([一二三四五六七八九十\d]+)[张个幅]?表", r"表([一二三四五六七八九十\d]+)")
KEYWORDS = ("图", "表", "图片", "图像", "图表", "示意图", "流程图")
#: Image references in Markdown and in HTML.
MARKDOWN_IMAGE, HTML_IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)", r"<img[^>]+src=[\"']([^\"']+)[\"'][^>]*>"
SUMMARY_PROMPT = "Summarise the paper below: title and authors, background and problem, methods, contributions, results, conclusions and future work.\n\n{content}\n\n{more}"
QA_PROMPT = "Answer the question from the paper below. Name the part that you rely on, and say so if the paper has no answer.\n\nPaper:\n{content}\n\n{more}\n\n{history}\n\nQuestion: {question}"
VISION_PROMPT = "Look at the image and answer the question.\n\nQuestion: {question}\n\nContext:\n{content}..."
ROUTE_PROMPT = f"Must the question be answered from an image, figure or chart? Reply {YES} or 否.\n\nQuestion: {{question}}"


def fill(template: str, **values: Column) -> Column:
    """A template's text with its {names} replaced by columns."""
    parts: list[Column] = []
    while template:
        before, brace, rest = template.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, template = rest.partition("}")
        parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts)


def turn_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer) of messages (conv_id, turn, role, text): a user's message and the assistant's next one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.filter("role in ('user', 'assistant')").withColumns({"next_role": F.lead("role").over(order), "answer": F.lead("text").over(order)})
    return rows.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def last_turns(pairs: DataFrame, n: int = KEPT_TURNS) -> DataFrame:
    """The last n turns of each conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return pairs.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)


def history(pairs: DataFrame, n: int = PROMPT_TURNS) -> DataFrame:
    """(conv_id, n_turns, history) of the last n turns, oldest first."""
    one = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer", F.lit("\n\n"))
    rows = last_turns(pairs, n).select("conv_id", "turn", one.alias("line"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda r: r["line"]), "").alias("history"))


def _more(content: Column, n: int) -> Column:
    return F.when(F.length(content) > n, "...").otherwise("")


def summary_prompt(content: Column) -> Column:
    return fill(SUMMARY_PROMPT, content=F.substring(content, 1, SUMMARY_CHARS), more=_more(content, SUMMARY_CHARS))


def qa_prompt(question: Column, content: Column, past: Column) -> Column:
    said = F.when(F.length(past) > 0, F.concat(F.lit("History:\n"), past))
    return fill(QA_PROMPT, question=question, content=F.substring(content, 1, QA_CHARS), more=_more(content, QA_CHARS), history=said)


def vision_prompt(question: Column, content: Column) -> Column:
    return fill(VISION_PROMPT, question=question, content=F.substring(content, 1, CONTEXT_CHARS))


def route_prompt(question: Column) -> Column:
    return fill(ROUTE_PROMPT, question=question)


def needs_vision(reply: Column) -> Column:
    """The router's yes within the first five characters of its reply; no reply means no. A negated yes counts too."""
    return F.coalesce(F.instr(F.substring(strip(reply), 1, 5), YES) > 0, F.lit(False))


def image_references(text: Column) -> Column:
    """Array of (alt_text, path, type): those of Markdown, then those of HTML."""
    alts, paths = (F.regexp_extract_all(text, F.lit(MARKDOWN_IMAGE), F.lit(k)) for k in (1, 2))
    in_markdown = F.zip_with(alts, paths, lambda a, p: F.struct(a.alias("alt_text"), p.alias("path"), F.lit("markdown").alias("type")))
    in_html = F.transform(F.regexp_extract_all(text, F.lit(HTML_IMAGE), F.lit(1)), lambda p: F.struct(F.lit("").alias("alt_text"), p.alias("path"), F.lit("html").alias("type")))
    return F.concat(in_markdown, in_html)


def selected_images(question: Column, images: Column) -> Column:
    """Images (an array) that the question names by number, in order of the patterns; else the first two if it asks for any; else none. Numbers count from 1."""
    numbers = F.concat(*(F.transform(F.regexp_extract_all(question, F.lit(p), F.lit(1)), numeral) for p in NUMBERED))
    chosen = F.array_distinct(F.transform(F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(images))), lambda n: F.element_at(images, n)))
    asked = question.rlike("|".join(KEYWORDS))
    return F.when(F.size(chosen) > 0, chosen).when(asked, F.slice(images, 1, 2)).otherwise(F.slice(images, 1, 0))


def images_or_first(selected: Column, images: Column, n: int = 3) -> Column:
    return F.when(F.size(selected) > 0, selected).otherwise(F.slice(images, 1, n))


def vision_answer(answers: DataFrame, by: str = "question_id") -> DataFrame:
    """One answer of those about each image (by, image_ord, answer): empty ones are left out; null if none is left."""
    rows = F.array_sort(F.collect_list(F.when(F.length(strip(F.col("answer"))) > 0, F.struct("image_ord", "answer"))))
    joined = F.array_join(F.transform(rows, lambda r: r["answer"]), "\n\n")
    return answers.groupBy(by).agg(F.when(F.length(joined) > 0, joined).alias("answer"))


def shortened(text: Column, n: int) -> Column:
    return truncate(text, n)

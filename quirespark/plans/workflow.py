"""The workflow over documents: elements, layout, HTML, Markdown, summary prompts. Stages run until one fails; each says how it went."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import elements as E
from quirespark.operators import htmltree, inference, layout, markdown, qa


@dataclass
class Workflow:
    """Named stages over a dict of tables; status() tells of those that ran."""

    spark: SparkSession
    stages: list[tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]]
    done: list[tuple[str, str, str, str | None]] = field(default_factory=list)

    def run(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        tables = dict(tables)
        for name, stage in self.stages:
            try:
                tables |= stage(tables)
                self.done.append((name, "success", f"{name} planned", None))
            except Exception as e:
                self.done.append((name, "error", f"{name} failed", f"{type(e).__name__}: {e}"))
                break
        return tables

    def status(self) -> DataFrame:
        return self.spark.createDataFrame(self.done, "stage string, status string, message string, error string")


def analyse_layout(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """elements, pages -> layouts, regions, slices."""
    layouts = layout.page_layout(t["elements"], t["pages"])
    found = layout.regions(t["elements"], t["pages"])
    return {"layouts": layouts, "regions": found, "slices": layout.slices(found)}


def convert_html(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """html_pages (page_id, html) -> blocks, markdown, statistics, document."""
    pages = t["html_pages"].select("page_id", "html")
    blocks = htmltree.page_blocks(pages)
    md = markdown.page_markdown(blocks, pages)
    return {"blocks": blocks, "markdown": md, "statistics": htmltree.page_statistics(pages), "document": markdown.merged(md)}


def summarise(client: Callable[[], inference.ModelClient], model: str, policy: inference.RetryPolicy = inference.RetryPolicy()) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    def stage(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        prompt = qa.summary_prompt(F.col("clean_md"))
        requests = t["document"].select(prompt.alias("prompt")).withColumn("request_key", inference.request_key(F.lit("summary"), F.col("prompt")))
        return {"summary": inference.call(requests, client, model, policy=policy)}

    return stage


def parse_slices(client: Callable[[], inference.ModelClient], model: str, prompt: str, policy: inference.RetryPolicy = inference.RetryPolicy(), parallelism: int | None = None, clean: bool = False) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    """slice_images (ord, content) -> html_pages; slices that fail leave a gap in the numbers."""

    def stage(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        requests = t["slice_images"].select(F.col("ord").cast("string").alias("request_key"), F.lit(prompt).alias("prompt"), F.col("content").alias("image"))
        replies = inference.call(requests, client, model, policy=policy, parallelism=parallelism).filter("error is null")
        html = htmltree.clean_html(F.col("reply")) if clean else F.col("reply")
        return {"html_pages": replies.select(F.col("request_key").cast("long").alias("page_id"), html.alias("html"))}

    return stage


def insert_images(prefix: str) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    """html_pages, image_paths (path) -> html_pages with the sources of the images extracted for their page."""

    def stage(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        index = htmltree.image_index(t["image_paths"], prefix).withColumnRenamed("page", "page_id")
        return {"html_pages": htmltree.insert_sources(t["html_pages"], index, page="page_id")}

    return stage


def answer(questions: DataFrame, client: Callable[[], inference.ModelClient], models: dict[str, str], policy: inference.RetryPolicy = inference.RetryPolicy()) -> DataFrame:
    """(question_id, needs_vision, answer, error) of questions (question_id, question, content, history, images).

    A router decides; questions that need images are asked about each selected one, and the answers joined; where none is of
    use, and for the others, the text answers. images: array of (path, content); without any the text answers.
    """
    q = questions.withColumn("qid", F.col("question_id").cast("string"))
    routed = inference.call(q.select(F.col("qid").alias("request_key"), qa.route_prompt(F.col("question")).alias("prompt")), client, models["router"], policy=policy)
    q = q.join(routed.select(F.col("request_key").alias("qid"), (qa.needs_vision(F.col("reply"))).alias("needs_vision")), "qid")
    paths = F.transform("images", lambda i: i["path"])
    looked = qa.images_or_first(qa.selected_images(F.col("question"), paths), paths)
    seen = q.filter(F.col("needs_vision") & (F.size("images") > 0)).withColumn("looked", looked).select("qid", qa.vision_prompt(F.col("question"), F.col("content")).alias("prompt"), F.posexplode(F.filter("images", lambda i: F.array_contains(F.col("looked"), i["path"]))).alias("image_ord", "i"))
    seen = seen.withColumn("request_key", F.concat_ws("/", "qid", F.col("image_ord").cast("string")))
    replies = inference.call(seen.select("request_key", "prompt", F.col("i.content").alias("image")), client, models["vision"], policy=policy)
    by_image = seen.select("qid", "image_ord", "request_key").join(replies, "request_key").select(F.col("qid").alias("question_id"), "image_ord", F.coalesce("reply", F.lit("")).alias("answer"))
    vision = qa.vision_answer(by_image).select(F.col("question_id").alias("qid"), F.col("answer").alias("vision_answer"))
    q = q.join(vision, "qid", "left")
    text = inference.call(q.filter("vision_answer is null").select(F.col("qid").alias("request_key"), qa.qa_prompt(F.col("question"), F.col("content"), F.col("history")).alias("prompt")), client, models["text"], policy=policy)
    out = q.join(text.select(F.col("request_key").alias("qid"), "reply", "error"), "qid", "left")
    return out.select("question_id", "needs_vision", F.coalesce("vision_answer", "reply").alias("answer"), "error")


def document_totals(elements: DataFrame, failed: DataFrame, by: str = "doc_id", page: str = "page_number") -> DataFrame:
    """Totals by document over its good pages, with the list of failed ones (by, page)."""
    counts = E.summary(elements, (by,))
    bad = failed.groupBy(by).agg(F.array_sort(F.collect_list(page)).alias("failed_pages"))
    return counts.join(bad, by, "full").withColumn("failed_pages", F.coalesce("failed_pages", F.expr("array()").cast("array<int>")))

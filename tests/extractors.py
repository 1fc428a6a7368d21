"""Extractors for tests; a module of their own, as the workers import it."""

import pandas as pd

from sitegrain.operators import extract


def answer(batches):
    """Answers with one job named by the page, two for pages with ``+``, none for pages with ``?``."""
    for batch in batches:
        text = batch["prompt"].str.removeprefix(extract.PROMPT)
        one = '{"job_title": "' + text + '", "links": "/own"}'
        reply = "```json\n[" + one.where(~text.str.contains("+", regex=False), one + ", " + one.str.upper().str.replace("JOB_TITLE", "job_title")) + "]\n```"
        yield batch[["url", "fetched_at"]].assign(response=reply.where(~text.str.contains("?", regex=False), "none"))


def fail(batches):
    raise RuntimeError("model is away")
    yield


def count_letters(batches):
    for batch in batches:
        yield batch[["url"]].assign(n=batch["html"].str.len())


def whole_batches(batches):
    for batch in batches:
        if (batch["id"] % 10 == 3).any():
            raise ValueError(f"bad {batch['id'].min()}")
        yield batch[["id"]].assign(answer="ok")


def row_by_row(batches):
    for batch in batches:
        for i in batch["id"]:
            if i % 10 == 3:
                raise KeyError(i)
            if i % 10 != 7:
                yield pd.DataFrame({"id": [i], "answer": ["ok"]})


def wrong_columns(batches):
    for batch in batches:
        yield batch[["id"]]


def failing_on_bad(batches):
    for batch in batches:
        if batch["prompt"].str.contains("BAD").any():
            raise RuntimeError("no")
        yield batch[["url", "fetched_at"]].assign(response='```json\n[{"job_title": "t", "links": "l"}]\n```')


def answer_without_links(batches):
    for batch in batches:
        yield batch[["url", "fetched_at"]].assign(response='```json\n[{"job_title": "a"}, {"job_title": "b", "links": " "}]\n```')

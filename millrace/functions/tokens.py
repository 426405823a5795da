"""Operations on token id arrays: truncation, labels, masks, log-probs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row.  Inside an array lambda a plain
    outer expression would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keep_last(ids: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n)


def keep_first(ids: Column, n: int | Column) -> Column:
    return F.slice(ids, F.lit(1), F.lit(n) if isinstance(n, int) else n)


def truncate_prompt(ids: Column, max_len: int | None, bos: int | None = None, eos: int | None = None) -> Column:
    """Prompt tokens keep the LAST ``max_len``; special tokens only when given."""
    if bos is not None:
        ids = F.array_prepend(ids, F.lit(bos).cast("long"))
    if eos is not None:
        ids = F.array_append(ids, F.lit(eos).cast("long"))
    return ids if max_len is None else keep_last(ids, max_len)


def truncate_completion(ids: Column, max_len: int | None, eos: int) -> Column:
    """EOS is appended first, then the FIRST ``max_len`` tokens are kept."""
    ids = F.array_append(ids, F.lit(eos).cast("long"))
    return ids if max_len is None else keep_first(ids, max_len)


def truncate_left_combined(prompt: Column, completion: Column, max_len: int) -> Column:
    """Prompt without the leading tokens by which prompt plus completion is too long."""
    over = F.greatest(F.size(prompt) + F.size(completion) - max_len, F.lit(0))
    return F.slice(prompt, over + 1, F.greatest(F.size(prompt) - over, F.lit(0)))


def answer_parts(prompt: Column, whole: Column) -> tuple[Column, Column]:
    """Ids of prompt plus answer, cut where the answer begins.  Where the prompt's last token changed by what follows it,
    that token counts as the answer's."""
    at = F.size(prompt) - F.when(keep_first(whole, F.size(prompt)) == prompt, 0).otherwise(1)
    at = F.greatest(at, F.lit(0))
    return keep_first(whole, at), F.slice(whole, at + 1, F.greatest(F.size(whole) - at, F.lit(0)))


def with_bos(ids: Column, bos: int | None) -> Column:
    """``bos`` first, once."""
    if bos is None:
        return ids
    return F.when(F.get(ids, F.lit(0)) == bos, ids).otherwise(F.array_prepend(ids, F.lit(bos).cast("long")))


def with_eos(ids: Column, eos: int | None) -> Column:
    """``eos`` last, once."""
    if eos is None:
        return ids
    return F.when(F.try_element_at(ids, F.lit(-1)) == eos, ids).otherwise(F.array_append(ids, F.lit(eos).cast("long")))


def budget_pair(prompt_c: Column, prompt_r: Column, chosen: Column, rejected: Column, max_len: int,
                max_prompt: int, mode: str = "keep_end", bos: int | None = None, eos: int | None = None,
                prompt: Column | None = None) -> dict[str, Column]:
    """Cut a pair to a token budget: first the prompts, then the answers.
    Labels repeat the ids with the prompt positions ignored.

    ``prompt`` (the chosen side's, if not given) is the prompt alone, as long as the shorter side's.  ``bos`` and ``eos`` are put
    around each side before anything is measured, unless they are there already."""
    if mode not in ("keep_start", "keep_end"):
        raise ValueError(f"unknown truncation mode: {mode}")
    shared = F.least(F.size(prompt_c), F.size(prompt_r))
    prompt = with_bos(keep_first(prompt_c if prompt is None else prompt, shared), bos)
    prompt_c, prompt_r = with_bos(prompt_c, bos), with_bos(prompt_r, bos)
    chosen, rejected = with_eos(chosen, eos), with_eos(rejected, eos)
    longer = F.greatest(F.size(chosen), F.size(rejected))
    cut = keep_first if mode == "keep_start" else keep_last
    out: dict[str, Column] = {}
    out["prompt_ids"] = F.when(F.size(prompt) + longer > max_len, cut(prompt, max_prompt)).otherwise(prompt)
    for side, p, a in (("chosen", prompt_c, chosen), ("rejected", prompt_r, rejected)):
        p2 = F.when(F.size(p) + longer > max_len, cut(p, max_prompt)).otherwise(p)
        a2 = F.when(F.size(p2) + longer > max_len, keep_first(a, max_len - max_prompt)).otherwise(a)
        out[f"{side}_ids"] = F.concat(p2, a2)
        out[f"{side}_labels"] = F.concat(F.array_repeat(F.lit(IGNORE).cast("long"), F.size(p2)), a2)
    return out


def prompts_agree(prompt_c: Column, prompt_r: Column) -> Column:
    """Prompts of a pair may differ in one token and in length by one."""
    n = F.least(F.size(prompt_c), F.size(prompt_r))
    differ = F.size(F.filter(F.arrays_zip(keep_first(prompt_c, n).alias("a"), keep_first(prompt_r, n).alias("b")),
                             lambda z: z["a"] != z["b"]))
    return (differ <= 1) & (F.abs(F.size(prompt_c) - F.size(prompt_r)) <= 1)


def step_labels(steps: Column, labels: Column, last_only: bool = False) -> Column:
    """Label per token of a step-wise answer: ignored but for each step's last
    token (the separator), which carries the step's label."""
    def one(s: Column, i: Column) -> Column:
        lab = F.element_at(labels, (i + 1).cast("int")).cast("long")
        if last_only:
            lab = F.when(i == F.size(steps) - 1, lab).otherwise(F.lit(IGNORE))
        return F.array_append(F.array_repeat(F.lit(IGNORE).cast("long"), F.size(s)), lab.cast("long"))
    return F.flatten(F.transform(steps, one))


def step_ids(steps: Column, sep: int) -> Column:
    return F.flatten(F.transform(steps, lambda s: F.array_append(s, F.lit(sep).cast("long"))))


def step_example(prompt: Column, steps: Column, labels: Column, sep: int, bos: int | None = None, max_prompt: int | None = None,
                 max_completion: int | None = None, max_len: int | None = None, last_only: bool = False) -> dict[str, Column]:
    """``input_ids`` and ``labels`` of a prompt and its steps, cut together: the prompt (after ``bos``) keeps its last
    tokens, the steps their first, the whole its first.  Prompt positions are ignored."""
    ids, marks = step_ids(steps, sep), step_labels(steps, labels, last_only)
    prompt = prompt if bos is None else F.array_prepend(prompt, F.lit(bos).cast("long"))
    if max_prompt is not None:
        prompt = keep_last(prompt, max_prompt)
    if max_completion is not None:
        ids, marks = keep_first(ids, max_completion), keep_first(marks, max_completion)
    out = {"input_ids": F.concat(prompt, ids), "labels": F.concat(F.array_repeat(F.lit(IGNORE).cast("long"), F.size(prompt)), marks)}
    return out if max_len is None else {k: keep_first(v, max_len) for k, v in out.items()}


def pad_count(ids: Column, prompt_len: Column | int, pad: int) -> Column:
    n = F.lit(prompt_len) if isinstance(prompt_len, int) else prompt_len
    return F.size(F.filter(F.slice(ids, F.lit(1), n), lambda x: x == pad))


def completion_mask(ids: Column, left_pad: Column, max_left_pad: Column, pad: int) -> Column:
    """1 where the position is in the completion and holds no pad."""
    return bind(max_left_pad - left_pad, lambda start: F.transform(
        ids, lambda x, i: ((i >= start) & (x != pad)).cast("int")))


def left_pack(ids: Column, pad: int) -> Column:
    return F.concat(F.filter(ids, lambda x: x != pad), F.filter(ids, lambda x: x == pad))


def align_logprobs(logps: Column, mask: Column) -> Column:
    """Shift right by the number of leading zeros in the mask; overflow is dropped."""
    at = F.array_position(mask, 1)
    lead = F.when(at == 0, F.size(mask)).otherwise(at - 1).cast("int")
    keep = F.greatest(F.size(mask) - lead, F.lit(0))
    moved = F.concat(F.array_repeat(F.lit(0.0), lead), F.slice(logps, F.lit(1), keep))
    return F.concat(moved, F.array_repeat(F.lit(0.0), F.greatest(F.size(mask) - F.size(moved), F.lit(0))))


def eos_mask(ids: Column, eos: int, drop_unfinished: bool = False) -> dict[str, Column]:
    """Mask up to and with the first EOS, completion length and whether it ended."""
    at = F.array_position(ids, F.lit(eos).cast("long"))
    length = F.when(at == 0, F.size(ids).cast("long")).otherwise(at)
    mask = bind(length, lambda n: F.transform(ids, lambda x, i: (i < n).cast("int")))
    if drop_unfinished:
        mask = F.when(at == 0, F.transform(ids, lambda x: F.lit(0))).otherwise(mask)
    return {"mask": mask, "length": length, "terminated": at > 0}


def cut_after_stop(ids: Column, stop: int, pad: int) -> dict[str, Column]:
    """Pads after the first stop token; length = index of the first pad - 1."""
    at = F.array_position(ids, F.lit(stop).cast("long"))
    cut = bind(at, lambda a: F.transform(
        ids, lambda x, i: F.when((a > 0) & (i >= a), F.lit(pad).cast("long")).otherwise(x)))
    first = F.array_position(cut, F.lit(pad).cast("long"))
    return {"ids": cut, "length": F.when(first == 0, F.size(cut).cast("long")).otherwise(first - 1) - 1}


def logsumexp(x: Column) -> Column:
    return bind(F.array_max(x), lambda m: m + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - m))))


def token_logprob(logits: Column, index: Column) -> Column:
    return F.element_at(logits, (index + 1).cast("int")) - logsumexp(logits)


def entropy(logits: Column) -> Column:
    return bind(logsumexp(logits), lambda z: z - F.aggregate(
        logits, F.lit(0.0), lambda a, v: a + F.exp(v - z) * v))


def hashed_words(text: Column, vocab: int, method: str = "xxhash64") -> Column:
    """Words (split at blanks and line ends) to ids below ``vocab`` by hash."""
    words = F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")
    return F.transform(words, lambda w: word_id(w, vocab, method))


def word_id(w: Column, vocab: int, method: str = "xxhash64") -> Column:
    """Id of one word: ``xxhash64`` is fast, ``md5`` gives the same ids outside Spark."""
    if method == "xxhash64":
        return F.pmod(F.xxhash64(w), F.lit(vocab).cast("long"))
    if method != "md5":
        raise ValueError(f"unknown hash: {method}")
    return F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % F.lit(vocab)

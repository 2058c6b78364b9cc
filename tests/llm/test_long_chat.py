"""Long conversations with templates that look far back."""

import pytest

from siltstone.llm import chat_format

TURNS = [(("user", "assistant")[i % 2], f"t{i}") for i in range(400)]


def numbered(turns):
    return "".join(f"#{i} {role}: {text}\n" for i, (role, text) in enumerate(turns))


def test_pieces_of_long_conversations_are_those_of_the_whole():
    got = list(chat_format.spans_of(numbered, iter(TURNS)))
    whole = numbered(TURNS)
    assert "".join(x[1] for x in got) == whole
    assert [x[2] for x in got] == [len(numbered(TURNS[:i])) for i in range(len(TURNS))]
    assert not any(x[4] for x in got)
    assert all(whole[x[2] + x[3][0] : x[2] + x[3][1]] == text for x, (role, text) in zip(got, TURNS, strict=True) if role == "assistant")


def test_a_rewrite_far_back_is_reported():
    def stripped(turns):
        return "".join(f"<{r}>" + ("" if r == "assistant" and i < len(turns) - 20 else t) for i, (r, t) in enumerate(turns))

    assert all(x[4] for i, x in enumerate(chat_format.spans_of(stripped, iter(TURNS))) if i > 256 and i % 2 == 1)


def test_ids_that_are_null_or_no_numbers(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), ("7", 0, "user", "c")]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 7: 1} and got[None].loss_chars == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        chat_format.format_turns(spark.createDataFrame([("x", 0, "user", "a")], "conv_id string, turn int, role string, text string")).collect()

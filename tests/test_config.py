import pytest

from lexiloom.functions import config


def test_overrides_are_coerced():
    s = config.load({"batch": {"size": 8}}, ["batch.drop_last=no", "encode.max_tokens=64", "encode.tokenizer=x.model", "clean.language=null"])
    assert (s.batch.size, s.batch.drop_last, s.encode.max_tokens, s.encode.tokenizer, s.clean.language) == (8, False, 64, "x.model", None)


@pytest.mark.parametrize("values, overrides", [({"nope": {}}, []), ({"batch": {"nope": 1}}, []), ({}, ["batch.nope=1"]), ({}, ["batch=1"]), ({}, ["nope"])])
def test_unknown_settings_fail(values, overrides):
    with pytest.raises(KeyError):
        config.load(values, overrides)

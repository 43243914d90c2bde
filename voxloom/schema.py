"""Schemas of the tables the operators exchange."""

from __future__ import annotations

MANIFEST_RAW = "ord bigint, uid string, audio_filepath string, text string, duration string, language string, dataset string, source string"
MANIFEST = "ord bigint, uid string, audio_filepath string, text string, duration double, language string, dataset string, source string"
SOURCE_SPEC = (
    "seq int, phase string, name string, hf_id string, config_name string, split string, lang string, samples int, text_col string, audio_col string, "
    "use_streaming boolean, start_offset bigint"
)
HYPOTHESIS = "utt_id bigint, split string, language string, dataset string, reference string, hypothesis string, decode_type string, beam_width int, alpha double, beta double"

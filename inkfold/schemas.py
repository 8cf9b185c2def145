"""Declared schemas (as DDL, for readers and ``from_json``) of the records the engine works on; a missing field is a null column, an unknown one is ignored."""

from __future__ import annotations

_FONT = (
    "filename string, name string, source string, category array<string>, tags array<string>, tag_weights array<double>, style string, weight int, fullName string, "
    "num_fonts int, classifications array<string>, stroke string, spacings array<string>, font_family_dir_name string, identifier string"
)
FONT_META = _FONT
FAMILY_NESTED = "name string, category array<string>, stroke string, classifications array<string>, fonts array<struct<name: string, filename: string, style: string, weight: int, fullName: string>>"
FAMILY_TAG = "font_family string, _empty string, raw_tags string, tag_weight double"
TAG_DIM = "raw_tags string, low double, high double, tags string"
MARKET_FILE = "ITEM_ID string, PATH_IN_ZIP string, FILE_TYPE string, MD5 string"
MARKET_ZIP = "ITEM_ID string, TITLE string, BRAND string, CATEGORY string, TAGS string, SPACINGS string"
PANGRAM = "svg string, svg_len int, prompt string, filename string, font_family_dir_name string, rendered_at timestamp_ntz"
GLYPH = "hash string, svg string"
CONTENT = "row_idx bigint, content string"
SFT = "instruction string, system string, output string, metadata string"
SFT_IMAGES = "instruction string, system string, output string, images array<string>, metadata string"
SFT_METADATA = _FONT + ", content_str string, svg_path string"
IMAGE_B64 = "row_idx bigint, img_hash string, img_base64 string"
OCR_TASK = "system string, instruction string, output string, images array<string>, metadata string"
USAGE = "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"
PREDICTION = "sample_id string, input_hash string, predict string, label string, metadata string, usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>, latency_sec double"
SCORE = "sample_id string, parsed_predict string, parsed_gt string, score boolean, metadata string"
TOKEN_STAT = "input_str_len bigint, input_token_len bigint, output_str_len bigint, output_token_len bigint, content_len bigint"
FONT_VERTICAL = "font_path string, ascender int, descender int, line_gap int, upm int, typo_ascender int, typo_descender int, typo_linegap int"
SPLIT_FAMILY = "index bigint, filename string, font_family_dir_name string"
SPLIT_CONTENT = "index bigint, content string"

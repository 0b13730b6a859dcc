"""Schemas of what is read; nothing is inferred in production paths."""

from __future__ import annotations

LOCATION = "struct<page:int,slide:int,section:string,timestamp_start:double,timestamp_end:double>"
BUNDLE = (
    "schema_version string, bundle_id string, created_at string, "
    "sources array<struct<id:string,kind:string,title:string,origin:struct<uri:string,local_path:string,sha256:string>,"
    "metadata:struct<collections:array<string>,tags:array<string>,obsidian_path:string>,"
    "extraction:struct<status:string,methods:array<string>,limitations:array<string>>>>, "
    f"content array<struct<id:string,source_id:string,sequence:double,modality:string,text:string,description:string,location:{LOCATION},"
    "asset:string,speaker:string,language:string,confidence:double,attributes:map<string,string>>>"
)
TRANSCRIPT = (
    "format string, source struct<name:string,sha256:string,duration_ms:bigint>, "
    "run struct<id:string,provider:string,model:string,language:string,diarization_provider:string>, "
    "speakers array<struct<id:string,display_name:string>>, "
    "segments array<struct<id:string,ordinal:int,start_ms:bigint,end_ms:bigint,start:double,end:double,speaker_id:string,speaker:string,"
    "raw_text:string,text:string,corrected_text:string,confidence:double,flags:array<string>>>"
)
GOLDEN = (
    "schema_version string, name string, cases array<struct<id:string,query:string,relevant_document_ids:array<string>,"
    "relevant_chunk_ids:array<string>,citation_targets:array<struct<target_id:string,chunk_ids:array<string>,document_ids:array<string>>>>>"
)
SEGMENT = (
    "document_id string, segment_id string, seq double, modality string, text string, section string, start double, end double, "
    "speaker string, quality string, page int, slide int"
)
JOB_EVENT = "job_id string, ordinal int, status string, percent int, event_ts timestamp"
MESSAGE = "conv_id long, turn long, role string, text string"
EMBEDDING = "chunk_id string, provider string, model string, vector array<float>"
EDGE = "source_id string, target_id string, relation_type string"
ITEM = (
    "item_id string, item_type string, status string, maturity string, title string, summary string, body string, "
    "aliases array<string>, tags array<string>, high_value boolean, has_evidence boolean, has_metadata boolean, updated_at string"
)

#: Values that columns may take (fixed values).
ENUMS = {
    "item_type": ("source", "topic", "entity", "analysis", "decision", "question", "output"),
    "status": ("current", "needs-review", "stale", "archived"),
    "maturity": ("unreviewed", "indexed", "summarized", "compiled"),
    "relation_type": ("supports", "contradicts", "extends", "part_of", "related"),
    "role": ("user", "assistant", "system"),
}

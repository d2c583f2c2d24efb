"""Table schemas."""

FIELD = "struct<value:string,source:string,confidence:double,priority:int>"
FIELDS = f"map<string,{FIELD}>"
HINTS = "struct<is_nextjs:boolean,is_cloudflare:boolean,cf_challenge:boolean,is_json:boolean,is_php:boolean>"

REQUESTS = "url string, api_endpoint string"
RESPONSES = (
    "page_id bigint, url string, status int, headers map<string,array<string>>, body binary, "
    "final_url string, content_type string, elapsed_ms bigint, fetched_at timestamp"
)
RENDERED_PAGES = "page_id bigint, url string, tier int, rendered_url string, html string, elapsed_ms bigint"
COMPLETIONS = "page_id bigint, completion string, error string"

TIER1 = (
    "struct<status_code:int,final_url:string,content_type:string,elapsed_ms:bigint,"
    "headers:map<string,string>,body:binary,fetched_at:timestamp>"
)
TIER2 = (
    "struct<decision:string,page_type:string,page_type_confidence:double,hollow_score:double,"
    f"tech_hints:{HINTS},fields:{FIELDS},elapsed_ms:bigint,analyzed_at:timestamp>"
)
# Tiers 3 and 4 share one shape.
RENDER_RESULT = (
    "struct<decision:string,page_type:string,page_type_confidence:double,hollow_score:double,"
    f"escalation_reason:string,fields:{FIELDS},elapsed_ms:bigint,rendered_at:timestamp>"
)
STAGES = (
    f"job_id string, url string, status string, updated_at timestamp, tier1 {TIER1}, tier2 {TIER2}, "
    f"tier3 {RENDER_RESULT}, tier4 {RENDER_RESULT}, final_decision string, final_fields {FIELDS}, "
    "stage int, batch_id string"
)

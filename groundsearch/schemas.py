"""Schemas of the records that are read and written."""

SECTION = "struct<kind:string,heading:string,text:string,page:int>"
NORMALIZED_DOC = (
    "doc_id string, title string, publisher string, source_url string, plan_year int, doc_type string, license_posture string, retrieval_date string, "
    f"measures array<struct<measure_id:string,measure_name:string,sections:array<{SECTION}>>>, general_sections array<{SECTION}>"
)
CHUNK = "chunk_id string, doc_id string, measure_id string, measure_name string, section string, header string, text string, plan_year int, license_posture string, source_url string, page int"
GOLD_ITEM = "item_id string, question string, category string, split string, gold array<struct<doc_id:string,measure_name_contains:string,section:string>>, reference_answer string"
#: The domains of these fields.
SECTION_KINDS = ("description", "numerator", "denominator", "exclusions", "timeline", "coding", "general")
COMMITTABLE = ("us_gov_public_domain", "redistributable")
COMMIT_POLICIES = ("commit_normalized", "fetch_only")
PARSERS = ("technical_notes", "generic_pdf", "ncqa_summary_html")

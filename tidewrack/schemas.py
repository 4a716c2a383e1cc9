"""Record types of the archive and the closed vocabularies their fields take."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed vocabularies.
PRECISIONS = ("exact", "month", "year", "approx", "before", "after", "between")
POINT_PRECISIONS = ("exact", "month", "year", "approx")
RELATIONSHIP_KINDS = ("spouse", "parent", "sibling", "inlaw", "teacher")
FAMILY_KINDS = ("spouse", "parent", "sibling", "inlaw")
PLACE_PRECISIONS = ("", "exact", "street", "town", "county", "region", "country", "continent")
ITEM_TYPES = ("letter", "document", "photo", "object", "ephemera", "audio", "video", "story", "event")
EVENT_KINDS = ("birth", "marriage", "death", "other")
ITEM_STATUSES = ("draft", "catalogued", "deleted")
TRANSCRIPTION_STATUSES = ("none", "draft", "confirmed")
RECORD_STATUSES = ("confirmed", "proposed", "estimated")
SESSION_STATUSES = ("pending", "reviewed")
REVIEW_DECISIONS = ("attested", "estimated", "pending", "delete")
IDENTITY_TABLES = ("people", "relationships", "places", "orgs", "themes")
ID_PATTERN = r"^[a-z][a-z0-9-]*$"

DATED = "struct<date:string,precision:string,date2:string>"
REF = f"struct<id:string,status:string,date:{DATED},people:array<string>>"

DDL = {
    "people": f"id string, name string, aliases array<string>, email string, pronouns string, years string, relation string, bio string, hue string, dob {DATED}, dod {DATED}, occupations array<string>, residence array<struct<place:string,from:string,to:string,status:string>>, status string, basis struct<text:string,by:string,when:string,note:string>",
    "relationships": f"a string, b string, kind string, label_a string, label_b string, date {DATED}, status string",
    "places": "id string, name string, aliases array<string>, note string, precision string, lat double, lng double, x int, y int, address string, status string",
    "orgs": "id string, name string, aliases array<string>, address string, branch string, note string, status string",
    "themes": "id string, title string, subtitle string, note string, items array<struct<id:string,note:string>>",
    "items": f"id string, type string, kind string, title string, date string, date_precision string, date2 string, status string, description string, story string, transcription string, transcription_status string, source string, provenance string, told_by string, comment_on string, recorded string, created string, created_at string, reason string, sensitive boolean, clarification boolean, reflection boolean, evidence boolean, people array<{REF}>, places array<{REF}>, themes array<{REF}>, orgs array<{REF}>, items array<{REF}>, assets array<struct<kind:string,file:string,caption:string>>, sources array<struct<url:string,title:string,accessed:string>>, date_mentions array<struct<date:string,precision:string>>, facts array<struct<kind:string,entity:string,text:string,value:string,precision:string,status:string,source:string>>, chat struct<extractions:array<struct<kind:string,name:string,match:string,bucket:string,reason:string,on:boolean>>>",
    "raw": "path string, record_id string, version int, payload string",
    "content": "item_id string, kind string, version int, file string, text string",
    "sessions": "id string, kind string, title string, status string, current string, attempts array<struct<started:string,messages:array<struct<role:string,text:string,when:string,thinking:string>>,decisions:array<struct<person_id:string,decision:string,when:string,basis:struct<text:string,by:string,when:string>,last:boolean>>>>",
    "batches": "batch_id string, path string, label string, source string, status string, arrived_at string, pages map<string,string>, fingerprint array<string>, content_changed boolean, boundaries array<struct<pages:array<string>,greeting:string,signoff:string,status:string>>",
    "page_flags": "page string, text string, starts_document boolean, ends_document boolean, greeting string, signoff string",
    "detections": "box array<double>, text string, score double",
    "layout": "page string, width int, height int, rotation int, lines array<struct<index:int,text:string,box:array<double>,conf:double,rec_text:string,rec_score:double,box_source:string,words:array<struct<word:string,conf:double>>>>, unmatched array<struct<box:array<double>,text:string,conf:double>>",
    "confirmations": "batch_id string, doc_index int, pages array<string>, text string, status string, confirmed_at string",
    "gedcom": "pos int, level int, xref string, tag string, value string",
}


def schema(name: str) -> T.StructType:
    """The Spark schema of a record type; explicit, so empty arrays keep their type."""
    return T._parse_datatype_string(DDL[name])

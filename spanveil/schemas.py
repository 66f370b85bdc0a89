"""Types shared by the operators."""

SPAN = "struct<start:int,end:int,label:string,txt:string,score:double,origin:string,validated:boolean,strong:boolean>"
SPANS = f"array<{SPAN}>"
GOLD_SPAN = "struct<id:string,label:string,group:string,text:string,char_start:int,char_end:int,bbox_px:array<int>,difficulty:string,min_coverage:double,note:string>"
GOLD_REGION = "struct<id:string,kind:string,bbox_px:array<int>,payload:string,contains_pii:boolean,expect:string>"
GOLD_PAGE = f"struct<width:int,height:int,canonical_text:string,spans:array<{GOLD_SPAN}>,optional_spans:array<{GOLD_SPAN}>,regions:array<{GOLD_REGION}>>"
GOLD_DOC = f"struct<doc_id:string,doc_type:string,schema_version:int,image:string,file:string,page:{GOLD_PAGE},pages:array<{GOLD_PAGE}>>"

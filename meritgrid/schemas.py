"""Schemas of the unified organisation record and its nested parts."""

CERT = (
    "struct<name:string,type:string,status:string,accreditation_date:string,expiry_date:string,"
    "accreditation_no:string,reference_no:string,remarks:string,score_impact:double,source:string>"
)
INITIATIVE = "struct<name:string,description:string,category:string,impact:string,impact_score:double,status:string>"
ORG_FIELDS = (
    "name string, original_name string, city string, state string, country string, region string, "
    "hospital_type string, address string, phone string, website string, email string, "
    f"data_source string, search_keywords array<string>, certifications array<{CERT}>, "
    f"quality_initiatives array<{INITIATIVE}>, quality_indicators map<string,boolean>, last_updated string"
)
ORG = "struct<" + ORG_FIELDS.replace(", ", ",").replace(" ", ":") + ">"

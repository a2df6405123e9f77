"""The queries of this subpackage and, where SQL can express them, their SQL."""

from foliant.llm import bpe, decontam, html_text, langid, pii, search, secrets, simhash, url_filter, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_warc": warc.op2_warc,
    "op3_secrets": secrets.op3_secrets,
    "op4_html": html_text.op4_html,
    "op5_language_id": langid.op5_language_id,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_search": search.op7_search,
    "op8_simhash": simhash.op8_simhash,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontam.op10_decontamination,
}

ORACLE: dict[str, str] = {"op2_warc": warc.ORACLE}

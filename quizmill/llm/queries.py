"""The queries of this subpackage and the SQL for those that SQL can express."""

from quizmill.llm import bpecodec, decontaminate, imatch, jaccard, langid, personal, secrets, substrings, tokencount, turns, urlfilter, variants, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": substrings.op1_suffix_dedup,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_warc": warc.op4_warc,
        "op5_imatch": imatch.op5_imatch,
        "op6_language_id": langid.op6_language_id,
        "op7_token_counts": tokencount.op7_token_counts,
        "op8_bpe": bpecodec.op8_bpe,
        "op9_url_filter": urlfilter.op9_url_filter,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op10_near": decontaminate.op10_near,
        "op11_conversation_repair": turns.op11_conversation_repair,
        "op12_personal_data": personal.op12_personal_data,
        "op13_spelling_variants": variants.op13_spelling_variants,
        "url_rules": urlfilter.url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard.SQL, "op4_warc": warc.SQL, "op10_decontaminate": decontaminate.SQL, "op11_conversation_repair": turns.SQL, "op13_spelling_variants": variants.SQL, "url_rules": urlfilter.SQL}

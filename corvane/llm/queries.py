"""The registered queries of the training-data operators and the SQL that repeats them."""

from corvane.llm import ann, centroids, chat_format, decontaminate, hmm, mixing, pieces, quality, simhash, toxicity, url_filter, variants, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op10_ann": ann.op10_ann,
    "op11_centroids": centroids.op11_centroids,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_variants": variants.op13_variants,
    "op2_hmm": hmm.op2_hmm,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_quality": quality.op5_quality,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": url_filter.op9_url_filter,
}

ORACLES = {
    "op11_centroids": centroids.OP11_SQL,
    "op13_variants": variants.OP13_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op6_warc": warc.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
}

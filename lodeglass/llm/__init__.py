"""Operations of a training-data pipeline over texts, one module each; nothing else in the library imports them."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions go to the executors whole, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])

from lodeglass.llm import (  # noqa: E402
    op1_secrets,
    op2_urls,
    op3_lines,
    op4_chat,
    op5_token_files,
    op6_decontamination,
    op7_substrings,
    op8_jaccard,
    op9_packing,
    op10_quality,
    op11_personal,
    op12_divergence,
    op13_codes,
)

QUERIES = {
    name: query
    for module in (
        op1_secrets, op2_urls, op3_lines, op4_chat, op5_token_files, op6_decontamination, op7_substrings, op8_jaccard,
        op9_packing, op10_quality, op11_personal, op12_divergence, op13_codes,
    )
    for name, query in module.QUERIES.items()
}

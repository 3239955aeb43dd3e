"""Named queries; importing the package registers all of them."""

from paginarium.plans import bidi_rules, block_rules, box_rules, codec_rules, form_rules, function_rules, page_rules, registry, surface_rules, text_rules, tree_rules  # noqa: F401

"""Operators for preparing training text: near-duplicates, language, scoring, packing,
decontamination, token counts and files, URL rules and toxicity.  Nothing outside this
package imports it."""

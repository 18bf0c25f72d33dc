"""Wording of the rule-based questions: difficulty, question and reasoning steps of every template.

``{x}`` stands for a column or expression read as text, ``[x]`` for one read as a number with two decimals. The texts become plain
SQL, so that both the jobs and their check SQL write the same records.
"""

from __future__ import annotations

import re

Words = tuple[str, ...]

CLOSER = "CASE WHEN chart_id % 2 = 0 THEN 'above' ELSE 'below' END"
END = "CASE WHEN chart_id % 2 = 0 THEN 'highest' ELSE 'lowest' END"

#: template: (difficulty, question, step, ...)
WORDING: dict[str, Words] = {
    # columns of a table
    "max_value": ("easy", "What is the largest {col}?", "Go through all values of {col}.", "The largest is [max_v], at {max_e}."),
    "diff_max_min": (
        "medium", "By how much do the largest and the smallest {col} differ?",
        "The largest {col} is [max_v].", "The smallest {col} is [min_v].", "[max_v] - [min_v] = [max_v - min_v]",
    ),
    "average": ("medium", "What is the mean {col} of the chart?", "The values add up to [sum_v].", "[sum_v] / [n] = [mean_v]"),
    "sum": ("medium", "What do all values of {col} add up to?", "There are {n} values of {col}.", "Together they make [sum_v]."),
    "ratio": (
        "hard", "How many times the smallest {col} is the largest one?",
        "The largest {col} is [max_v], the smallest [min_v].", "[max_v] / [min_v] = [max_v / nullif(min_v, 0)]",
    ),
    "which_highest": ("easy", "Which entry has the largest {col}?", "The largest {col} is [max_v].", "It stands at {max_e}."),
    "which_lowest": ("easy", "Which entry has the smallest {col}?", "The smallest {col} is [min_v].", "It stands at {min_e}."),
    "percentage": (
        "hard", "Which share of the total {col}, in percent, belongs to {e1}?",
        "The {col} of {e1} is [v1].", "All values add up to [sum_v].", "The share is [v1 / nullif(sum_v, 0) * 100] percent.",
    ),
    "diff_entities": (
        "medium", "How far apart are {e1} and {e2} in {col}?",
        "{e1} has [v1].", "{e2} has [v2].", "[greatest(v1, v2)] - [least(v1, v2)] = [abs(v1 - v2)]",
    ),
    "value_reading": ("easy", "Which {col} does the chart show for {e1}?", "Find {e1}.", "Its {col} is [v1]."),
    "which_entity_highest": ("easy", "Whose {col} is the largest?", "The largest {col} is [max_v].", "It belongs to {max_e}."),
    "which_entity_lowest": ("easy", "Whose {col} is the smallest?", "The smallest {col} is [min_v].", "It belongs to {min_e}."),
    "title_reading": ("easy", "What is the title of the chart?", "The title stands above the plot."),
    "label_reading": ("easy", "What is the name of the value column that has {n} values and the maximum [max_v]?", "Read the axis label.", "It says {col}."),
    "yes_no_comparison": ("easy", "Does {e1} have more {col} than {e2}?", "{e1} has [v1].", "{e2} has [v2]."),
    "trend_direction": (
        "medium", "Does {col} rise or fall from the first half of the rows to the second?",
        "The first half has the mean [head_mean].", "The second half has the mean [tail_mean].",
    ),
    "count_above": ("hard", "How many entries lie above the median {col}?", "The median {col} is [median_v].", "Above it lie {n_above_median} entries."),
    "how_many_above": (
        "medium", "How many entries have a {col} {" + CLOSER + "} [cut_v]?", "Compare each value with [cut_v].", "Count those {" + CLOSER + "} it.",
    ),
    "which_highest_lowest": ("easy", "Which entry has the {" + END + "} {col}?", "The values run from [min_v] to [max_v].", "Take the {" + END + "}."),
    "difference_between": ("medium", "What is the difference in {col} between {e1} and {e2}?", "{e1}: [v1].", "{e2}: [v2].", "[greatest(v1, v2)] - [least(v1, v2)] = [abs(v1 - v2)]"),
    "average_simple": ("medium", "What is the average {col}?", "The sum is [sum_v], over {n} entries.", "[sum_v] / [n] = [mean_v]"),
    "value_of": ("easy", "What is the {col} of {label}?", "Find {label}.", "Its {col} is [value]."),
    # one curve, or two
    "sci_scatter_trend": ("easy", "Do the points rise or fall along the x axis?", "A line through the points has the slope [slope]."),
    "sci_scatter_fit_quality": ("medium", "How well does a straight line fit the points?", "The fit explains a share of [r2] of the variance."),
    "sci_scatter_lookup": ("easy", "Which y value does the point at x = {mid_x} have?", "Go to x = {mid_x}.", "The point lies at [mid_y]."),
    "sci_residual": (
        "hard", "How far above its predicted value does the point at x = {mid_x} lie?",
        "The point lies at [mid_y].", "The prediction is [mid_y2].", "[mid_y] - [mid_y2] = [mid_y - mid_y2]",
    ),
    "sci_r2": ("hard", "What is the coefficient of determination of the linear fit?", "It is the squared correlation of x and y.", "It comes to [r2]."),
    "sci_eb_best": ("easy", "Which entry has the highest mean?", "The highest mean is [y_max]."),
    "sci_eb_worst": ("easy", "Which entry has the lowest mean?", "The lowest mean is [y_min]."),
    "sci_eb_low_std": ("medium", "Which entry has the shortest error bar?", "Compare the lengths of all error bars."),
    "sci_eb_diff": ("medium", "How far apart are the best and the worst mean?", "The best mean is [y_max].", "The worst is [y_min].", "[y_max] - [y_min] = [y_max - y_min]"),
    "sci_eb_lookup": ("easy", "Which mean does the marked entry have?", "The entry's marker lies at [pick_y]."),
    "sci_log_trend": ("easy", "Does the curve on the logarithmic axis go up or down?", "It starts at [y_first] and ends at [y_last]."),
    "sci_log_pattern": ("medium", "What kind of growth does the curve show?", "It starts at [y_first].", "It ends at [y_last]."),
    "sci_log_lookup": ("easy", "Which value does the curve have at x = {mid_x}?", "At x = {mid_x} it passes [mid_y]."),
    "sci_log_oom": ("hard", "How many orders of magnitude lie between the first and the last value?", "The first value is [y_first], the last [y_last].", "Take the decimal logarithm of their ratio."),
    "sci_dual_ratio": ("hard", "At x = {mid_x}, how many times the right curve's value is the left one's?", "The left curve has [mid_y].", "The right curve has [mid_y2]."),
    "sci_dual_which": ("easy", "Which curve is higher at x = {mid_x}?", "The left curve has [mid_y].", "The right curve has [mid_y2]."),
    "sci_dual_peak": ("medium", "At which x does the left curve peak?", "Its highest value is [y_max]."),
    "sci_dual_dominant": ("medium", "Which curve is higher on average?", "The left curve's mean is [y_mean].", "The right curve's mean is [y2_mean]."),
    "v2_trend": ("easy", "What is the overall trend of the curve?", "A fitted line has the slope [slope]."),
    "v2_monotonic": ("medium", "Does the curve change its direction?", "Compare each value with the next one."),
    "v2_peak_x": ("easy", "Where on the x axis does the curve reach its maximum?", "The maximum is [y_max]."),
    "v2_max_y": ("easy", "What is the maximum of the curve?", "Find the highest point.", "It lies at [y_max]."),
    "v2_mean": ("medium", "What is the mean of all points of the curve?", "There are {n} points.", "Their mean is [y_mean]."),
    # panels, matrices, bands, violins
    "sci_panel_ranking": ("medium", "Which of the {n_panels} panels reaches the highest value?", "Compare the peaks of all panels."),
    "sci_panel_peak_epoch": ("medium", "In which epoch does the marked panel peak?", "Its peak is [top]."),
    "sci_panel_max": ("easy", "What is the peak of the marked panel?", "It is reached in epoch {peak_epoch}."),
    "sci_panel_final": ("easy", "At which value does the marked panel end?", "Go to the last epoch.", "The value is [final]."),
    "sci_panel_convergence": ("hard", "Which panel is the steadiest in its second half?", "Compare the spread of the later epochs."),
    "sci_corr_strongest": ("medium", "Which two variables are correlated most?", "Compare all {n_pairs} cells below the diagonal."),
    "sci_corr_target": ("medium", "Which variable goes best with number {chart_id % 7 + 1}?", "Read its row and its column."),
    "sci_corr_cell": ("easy", "What is the correlation of variables 1 and 2?", "Read the cell: [cell]."),
    "sci_corr_sign": ("easy", "Are variables 1 and 2 positively or negatively correlated?", "Their cell shows [cell]."),
    "sci_corr_min": ("medium", "What is the lowest correlation of the matrix?", "Compare all {n_pairs} cells.", "The lowest is [weakest_r]."),
    "sci_cb_width": ("medium", "How wide is the band of the marked method at its middle row?", "Subtract its lower from its upper edge.", "The width is [mid_width]."),
    "sci_cb_lookup": ("easy", "Which value does the marked method have at its middle row?", "The line passes [mid_y]."),
    "sci_cb_mean_width": ("hard", "How wide is the marked method's band on average?", "Average the widths over all rows."),
    "sci_cb_max_y": ("easy", "What is the highest value of the marked method?", "Its line peaks at [max_y]."),
    "sci_cb_widest": ("medium", "Which of the {n_methods} methods has the widest band on average?", "Compare the mean widths."),
    "sci_cb_best": ("medium", "Which of the {n_methods} methods has the highest mean?", "Compare the mean values."),
    "sci_violin_median": ("easy", "What is the median of the marked violin?", "The white mark lies at [med]."),
    "sci_violin_range": ("medium", "Which range does the marked violin span?", "Its ends are [max_y] and [min_y].", "[max_y] - [min_y] = [max_y - min_y]"),
    "sci_violin_highest_median": ("easy", "Which violin has the highest median?", "Compare the {n_methods} white marks."),
    "sci_violin_widest": ("medium", "Which violin shows the widest spread?", "Compare the standard deviations."),
    "sci_violin_iqr": ("hard", "How far apart are the quartiles of the marked violin?", "The box is [iqr] high."),
    "hypothetical": ("hard", "Suppose the {col} of {e1} rose by {raised} percent. What would it be?", "The {col} of {e1} is [v1].", "Add {raised} percent."),
    "unanswerable": ("hard", "What is the {col} of {entity}?", "Look for {entity}.", "The chart does not show it."),
    "multi_choice": ("medium", "What is the {col} of {e1}? A) [o0], B) [o1], C) [o2], D) [o3]", "The {col} of {e1} is [v1]."),
    "conversational": ("hard", "Who has the largest {col}? And what is the {col} of {e2}?", "The largest is [max_v], at {max_e}.", "{e2} has [v2]."),
}


def spark_number(x: str) -> str:
    return f"CAST(CAST(round(round(CAST({x} AS DOUBLE), 6), 2) AS DECIMAL(24, 2)) AS STRING)"


def sql_text(text: str, number=spark_number) -> str:
    """SQL expression of a text with marks; null where a marked value is null."""
    parts = []
    for plain, mark in re.findall(r"([^{}\[\]]+)|(\{[^}]*\}|\[[^\]]*\])", text):
        if plain:
            parts.append("'" + plain.replace("'", "''") + "'")
        else:
            parts.append(f"CAST({mark[1:-1]} AS STRING)" if mark[0] == "{" else number(mark[1:-1]))
    return " || ".join(parts)


def record(name: str, number=spark_number) -> tuple[str, str, list[str]]:
    """Difficulty, question and steps of a template as SQL."""
    difficulty, question, *steps = WORDING[name]
    return f"'{difficulty}'", sql_text(question, number), [sql_text(s, number) for s in steps]

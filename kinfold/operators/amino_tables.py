"""Published score tables of amino acids, for ``mutations.blosum62`` and ``mutations.pam``.

Each is the part below the diagonal of a symmetric table of exchange rates, a
line for each amino acid in the order of ``mutations.AMINO_ACIDS`` from the second
on, and the frequencies of all twenty.
"""

#: Exchange rates and frequencies of BLOSUM62 (Henikoff and Henikoff 1992; Yu, Wootton and Altschul 2003).
BLOSUM62_RATES = """
0.735790389698
0.485391055466 1.297446705134
0.543161820899 0.500964408555 3.180100048216
1.459995310470 0.227826574209 0.397358949897 0.240836614802
1.199705704602 3.020833610064 1.839216146992 1.190945703396 0.329801504630
1.170949042800 1.360574190420 1.240488508640 3.761625208368 0.140748891814 5.528919177928
1.955883574960 0.418763308518 1.355872344485 0.798473248968 0.418203192284 0.609846305383 0.423579992176
0.716241444998 1.456141166336 2.414501434208 0.778142664022 0.354058109831 2.435341131140 1.626891056982 0.539859124954
0.605899003687 0.232036445142 0.283017326278 0.418555732462 0.774894022794 0.236202451204 0.186848046932 0.189296292376 0.252718447885
0.800016530518 0.622711669692 0.211888159615 0.218131577594 0.831842640142 0.580737093181 0.372625175087 0.217721159236 0.348072209797 3.890963773304
1.295201266783 5.411115141489 1.593137043457 1.032447924952 0.285078800906 3.945277674515 2.802427151679 0.752042440303 1.022507035889 0.406193586642 0.445570274261
1.253758266664 0.983692987457 0.648441278787 0.222621897958 0.767688823480 2.494896077113 0.555415397470 0.459436173579 0.984311525359 3.364797763104 6.030559379572 1.073061184332
0.492964679748 0.371644693209 0.354861249223 0.281730694207 0.441337471187 0.144356959750 0.291409084165 0.368166464453 0.714533703928 1.517359325954 2.064839703237 0.266924750511 1.773855168830
1.173275900924 0.448133661718 0.494887043702 0.730628272998 0.356008498769 0.858570575674 0.926563934846 0.504086599527 0.527007339151 0.388355409206 0.374555687471 1.047383450722 0.454123625103 0.233597909629
4.325092687057 1.122783104210 2.904101656456 1.582754142065 1.197188415094 1.934870924596 1.769893238937 1.509326253224 1.117029762910 0.357544412460 0.352969184527 1.752165917819 0.918723415746 0.540027644824 1.169129577716
1.729178019485 0.914665954563 1.898173634533 0.934187509431 1.119831358516 1.277480294596 1.071097236007 0.641436011405 0.585407090225 1.179091197260 0.915259857694 1.303875200799 1.488548053722 0.488206118793 1.005451683149 5.151556292270
0.465839367725 0.426382310122 0.191482046247 0.145345046279 0.527664418872 0.758653808642 0.407635648938 0.508358924638 0.301248600780 0.341985787540 0.691474634600 0.332243040634 0.888101098152 2.074324893497 0.252214830027 0.387925622098 0.513128126891
0.718206697586 0.720517441216 0.538222519037 0.261422208965 0.470237733696 0.958989742850 0.596719300346 0.308055737035 4.218953969389 0.674617093228 0.811245856323 0.717993486900 0.951682162246 6.747260430801 0.369405319355 0.796751520761 0.801010243199 4.054419006558
2.187774522005 0.438388343772 0.312858797993 0.258129289418 1.116352478606 0.530785790125 0.524253846338 0.253340790190 0.201555971750 8.311839405458 2.231405688913 0.498138475304 2.575850755315 0.838119610178 0.496908410676 0.561925457442 2.253074051176 0.266508731426 1.000000000000
"""
BLOSUM62_FREQUENCIES = "0.074 0.052 0.045 0.054 0.025 0.034 0.054 0.074 0.026 0.068 0.099 0.058 0.025 0.047 0.039 0.057 0.051 0.013 0.032 0.073"

#: Exchange rates and frequencies of PAM (Dayhoff, Schwartz and Orcutt 1978; Kosiol and Goldman 2005).
PAM_RATES = """
0.267828
0.984474 0.327059
1.199805 0.000000 8.931515
0.360016 0.232374 0.000000 0.000000
0.887753 2.439939 1.028509 1.348551 0.000000
1.961167 0.000000 1.493409 11.388659 0.000000 7.086022
2.386111 0.087791 1.385352 1.240981 0.107278 0.281581 0.811907
0.228116 2.383148 5.290024 0.868241 0.282729 6.011613 0.439469 0.106802
0.653416 0.632629 0.768024 0.239248 0.438074 0.180393 0.609526 0.000000 0.076981
0.406431 0.154924 0.341113 0.000000 0.000000 0.730772 0.112880 0.071514 0.443504 2.556685
0.258635 4.610124 3.148371 0.716913 0.000000 1.519078 0.830078 0.267683 0.270475 0.460857 0.180629
0.717840 0.896321 0.000000 0.000000 0.000000 1.127499 0.304803 0.170372 0.000000 3.332732 5.230115 2.411739
0.183641 0.136906 0.138503 0.000000 0.000000 0.000000 0.000000 0.153478 0.475927 1.951951 1.565160 0.000000 0.921860
2.485920 1.028313 0.419244 0.133940 0.187550 1.526188 0.507003 0.347153 0.933709 0.119152 0.316258 0.335419 0.170205 0.110506
4.051870 1.531590 4.885892 0.956097 1.598356 0.561828 0.793999 2.322243 0.353643 0.247955 0.171432 0.954557 0.619951 0.459901 2.427202
3.680365 0.265745 2.271697 0.660930 0.162366 0.525651 0.340156 0.306662 0.226333 1.900739 0.331090 1.350599 1.031534 0.136655 0.782857 5.436674
0.000000 2.001375 0.224968 0.000000 0.000000 0.000000 0.000000 0.000000 0.270564 0.000000 0.461776 0.000000 0.000000 0.762354 0.000000 0.740819 0.000000
0.244139 0.078012 0.946940 0.000000 0.953164 0.000000 0.214717 0.000000 1.265400 0.374834 0.286572 0.132142 0.000000 6.952629 0.000000 0.336289 0.417839 0.608070
2.059564 0.240368 0.158067 0.178316 0.484678 0.346983 0.367250 0.538165 0.438715 8.810038 1.745156 0.103850 2.565955 0.123606 0.485026 0.303836 1.561997 0.000000 0.279379
"""
PAM_FREQUENCIES = "0.087127 0.040904 0.040432 0.046872 0.033474 0.038255 0.049530 0.088612 0.033619 0.036886 0.085357 0.080481 0.014753 0.039772 0.050680 0.069577 0.058542 0.010494 0.029916 0.064717"

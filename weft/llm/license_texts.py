"""Word bigrams of full licence texts, as in ``license_bigrams``; that of AGPL-3.0 is made from GPL-3.0 by the passages in which they differ."""

TEXTS = {
    'AGPL-3.0#text': (
        '0 definitions|1 a|1 assert|1 cause|1 displays|1 source|10 9|10 automatic|10 if|10 makes|11 however|11 of|11 patents|12 no|13 remote|14 revised|15 and|'
        '15 disclaimer|16 if|16 limitation|16 of|17 interpretation|1996 or|2 access|2 anything|2 arrange|2 basic|2 offer|2 tells|20 december|2007 copyright|200'
        '7 free|2007 nothing|28 march|29 june|3 29|3 arrange|3 of|3 protecting|30 days|4 and|4 conveying|4 provided|4 to|5 conveying|5 provided|6 conveying|60 '
        'days|6b d|6d a|7 additional|7 apply|7 this|8 termination|9 acceptance|a brief|a certain|a charge|a compilation|a compiler|a computer|a consequence|a c'
        'onsumer|a contributor|a convenient|a convey|a copy|a copyright|a country|a covered|a cross|a designated|a different|a disclaiming|a discriminatory|a d'
        'istinguishing|a durable|a dwelling|a failure|a fashion|a fee|a fixed|a format|a free|a further|a gui|a in|a is|a larger|a later|a lawsuit|a license|a '
        'list|a major|a manner|a means|a menu|a modified|a network|a new|a non|a notice|a particular|a party|a patent|a physical|a pointer|a price|a private|a '
        'product|a program|a programmer|a prominent|a provisionally|a proxy|a publicly|a recognized|a relevant|a requirement|a result|a right|a royalty|a separ'
        'able|a separately|a short|a single|a specific|a standard|a statement|a storage|a subroutine|a system|a term|a the|a third|a transaction|a typical|a us'
        'er|a version|a volume|a warranty|a whole|a work|a written|ability to|about box|above be|above cannot|above requirements|absence of|absolute waiver|abs'
        'olutely no|accept this|acceptance however|acceptance not|acceptance of|access from|access or|access to|accessible means|accompanied by|accompanies a|a'
        'ccord with|according to|achieve this|acknowledges your|acquired or|acquired that|across the|actions infringe|activities as|activities but|activities h'
        'owever|activity of|actual knowledge|actually uses|adapt all|add information|add terms|add to|added by|added in|added under|additional obligations|addi'
        'tional or|additional permissions|additional terms|address new|addressed as|adopted on|adversely affects|advised of|affects the|affero general|affirmed'
        ' under|affirms your|after the|after your|against the|aggregate 6|aggregate does|aggregate if|agree to|agreed to|agreement or|all assets|all civil|all '
        'for|all its|all material|all necessary|all notices|all of|all or|all other|all patent|all recipients|all rights|all the|all users|all versions|all vio'
        'lation|alleging that|allowed only|allowed preamble|allowed section|along with|already acquired|also add|also convey|also get|also means|also meet|also'
        ' receives|alternative is|among developers|an about|an absolute|an aggregate|an agreement|an appropriate|an arrangement|an effective|an entity|an exact'
        '|an executable|an express|an implementation|an interactive|an interface|an object|an offer|an official|an opportunity|an organization|ancillary propag'
        'ation|and 16|and 2|and 5|and a|and adversely|and all|and any|and appropriately|and are|and authors|and b|and change|and charge|and conditions|and cont'
        'rol|and corresponding|and distribute|and dynamically|and each|and execute|and finally|and fitness|and follow|and for|and give|and giving|and grant|and'
        ' how|and in|and independent|and installation|and its|and limitation|and modification|and must|and noncommercially|and not|and offer|and only|and or|an'
        'd other|and otherwise|and paper|and performance|and prominently|and propagate|and protocols|and recipients|and show|and so|and that|and the|and this|a'
        'nd to|and under|and until|and use|and valid|and which|and will|and with|and works|and you|anti circumvention|any additional|any applicable|any attempt'
        '|any author|any conditions|any copies|any copyright|any copyrightable|any covered|any express|any further|any general|any implied|any intention|any ki'
        'nd|any later|any legal|any liability|any medium|any methods|any non|any of|any on|any other|any part|any patent|any portion|any price|any tangible|any'
        ' third|any to|any version|any warranty|any work|anyone to|anyone who|anything designed|anything other|anything that|anything with|applicable copyright'
        '|applicable law|applicable patent|applicable section|applicable terms|applicable to|applications with|applies to|apply along|apply and|apply either|ap'
        'ply if|apply local|apply only|apply these|apply to|appropriate copyright|appropriate legal|appropriate parts|appropriately publish|approximates an|are'
        ' a|are all|are applicable|are being|are considered|are designed|are granted|are imposed|are intended|are irrevocable|are met|are not|are packaged|are '
        'provided|are referring|are specifically|are terms|are used|are valid|are welcome|arising out|arrange in|arrange to|arrangement or|arrangement with|arr'
        'angement you|article 11|as a|as an|as by|as different|as exceptions|as excluding|as expressly|as is|as long|as needed|as part|as permitted|as provided'
        '|as published|as semiconductor|as though|as to|as well|as you|as your|assert copyright|assets of|associated with|assume the|assumption of|assumptions '
        'directly|assumptions of|at all|at least|at no|at your|attach the|attach them|attempt otherwise|attributions in|author attributions|author or|author th'
        'is|authorization keys|authorized by|authorizes use|authorizes you|authorizing them|authors all|authors of|automatic licensing|automatically extended|a'
        'utomatically from|automatically receives|automatically terminate|available for|available free|available network|available or|available to|away your|b '
        'convey|b permanently|b primarily|b requiring|b serves|b the|based on|based the|basic permissions|be accompanied|be available|be construed|be deemed|be'
        ' denied|be different|be given|be in|be included|be individuals|be infringed|be liable|be marked|be of|be on|be resolved|be similar|be so|be stated|be '
        'to|be treated|be used|be useful|be written|because modification|been advised|been installed|been made|been modified|been terminated|behalf under|being'
        ' offered|being rendered|believe are|below sublicensing|benefit of|best way|between those|beyond what|body or|both those|box you|brief idea|business of'
        '|but changing|but do|but first|but for|but it|but may|but not|but permits|but the|but this|but which|but without|by a|by anyone|by applicable|by contr'
        'ast|by copyright|by court|by electronic|by exercising|by intimate|by making|by modifying|by offering|by procuring|by providing|by some|by the|by their'
        '|by third|by this|by version|by works|by you|c 2007|c convey|c for|c prohibiting|c should|c year|c you|called a|called an|called the|can be|can change'
        '|can decide|can do|can get|can give|can redistribute|can regenerate|cannot be|cannot convey|carry prominent|case of|case prevented|cases shall|cases w'
        'hen|cause the|cause this|cease all|certain cases|certain conditions|certain numbered|cessation moreover|change all|change the|change under|changing it'
        '|characterized the|charge and|charge any|charge c|charge for|charge through|charge under|charge you|choose any|choose that|choosing to|circumstances i'
        's|circumvention is|circumvention law|circumvention of|civil liability|claim is|claim or|claims are|claims owned|claims that|claims to|class of|clear d'
        'irections|closely approximates|code and|code as|code by|code either|code for|code form|code if|code in|code interpreter|code is|code keep|code means|c'
        'ode needed|code on|code or|code saying|code the|code under|code using|code whose|code with|code work|collect a|combine any|combined will|combined with'
        '|combined work|comes into|comes with|commands might|commands or|commands show|commercial industrial|commitment however|commitment not|common use|commu'
        'nication across|communication or|community in|compilation and|compilation of|compilation s|compilations that|compiler used|compliance by|comply with|c'
        'omponent and|component but|component in|component kernel|component or|computer network|computer or|concerns each|conditioned on|conditions 0|condition'
        's a|conditions added|conditions additional|conditions are|conditions either|conditions for|conditions how|conditions of|conditions so|conditions state'
        'd|conditions type|connection with|consequence of|consequence you|consequential damages|consider it|considered further|consistent with|conspicuously an'
        'd|constitutes a|construed as|consumer product|consumer uses|contact you|contain the|containing it|contains a|content constitutes|contents of|context m'
        'eans|continue to|continued functioning|contractual assumptions|contradict the|contrast our|contributor grants|contributor is|contributor s|contributor'
        ' version|contributor whether|control copyright|control flow|control includes|control of|control on|control those|controlled by|convenient and|convey a'
        '|convey an|convey and|convey covered|convey individual|convey it|convey or|convey the|convey verbatim|convey without|conveyance of|conveyed and|convey'
        'ed by|conveyed under|conveying all|conveying an|conveying from|conveying if|conveying modified|conveying non|conveying occurs|conveying of|conveying t'
        'he|conveying under|conveying verbatim|conveys the|cooperation with|copies made|copies mere|copies of|copies or|copies you|copy an|copy and|copy distri'
        'bute|copy free|copy from|copy is|copy likewise|copy of|copy or|copy propagation|copy that|copy the|copy this|copying 7|copying distribution|copying fa'
        'cilities|copying of|copyleft license|copyright also|copyright are|copyright c|copyright disclaimer|copyright holder|copyright holders|copyright if|cop'
        'yright law|copyright like|copyright line|copyright notice|copyright on|copyright permission|copyright those|copyright treaty|copyrightable work|copyri'
        'ghted material|correction 16|corresponding source|cost of|could give|could satisfy|counterclaim in|countries other|country or|country that|country wou'
        'ld|course your|court order|courts shall|covenant not|coverage for|coverage prohibits|covered by|covered work|covered works|criterion 1|cross claim|cur'
        'e the|customarily used|customary means|customer support|d convey|d if|d limiting|damages 17|damages arising|damages including|data being|data communic'
        'ation|data or|date b|days after|december 1996|decide which|declining to|deemed part|defective you|defenses to|defined by|definition control|definition'
        ' files|definitions this|denied when|denominated not|deprive yourself|designated place|designed or|designed to|detail to|details the|details type|detai'
        'ls you|determining whether|develop a|developers that|developers working|differ in|different for|different from|different permissions|different server|'
        'differently from|direction and|directions next|directly impose|directly or|disclaim any|disclaimer for|disclaimer of|disclaiming warranty|discriminato'
        'ry if|discriminatory patent|display appropriate|displayed by|displays an|displays appropriate|distinguishing version|distribute and|distribute copies|'
        'distribute verbatim|distributed in|distributing software|distribution and|distribution medium|distribution with|do anything|do not|do so|do these|do u'
        'se|document but|document contains|document provided|documented and|does copyright|does not|does terminal|doubtful cases|downstream recipients|durable '
        'physical|dwelling in|dynamically linked|e convey|e declining|each contributor|each copy|each file|each licensee|each must|each party|each source|each '
        'time|each version|earlier work|effect according|effected by|effective technological|effectively state|efforts you|either 1|either expressed|either is|'
        'either of|either the|either version|either way|electronic and|embodied in|employer if|enable use|enables other|end of|enforce a|enforcing against|enfo'
        'rcing compliance|ensure cooperation|ensure that|entered into|entire program|entire risk|entire work|entirely from|entity transaction|equivalent access'
        '|equivalent as|equivalent copying|essential component|essential patent|even if|even the|event unless|ever published|everyone can|everyone is|exact cop'
        'y|example corresponding|example if|example the|example you|except as|except executing|except to|except when|exceptions from|exceptions the|excluded fr'
        'om|excluding or|exclusion of|exclusive worldwide|exclusively for|exclusively on|excuse you|executable work|execute modified|executing it|exercise of|e'
        'xercising rights|expected to|expects or|explicitly affirms|explicitly and|express agreement|express permission|expressed or|expressly provided|extend '
        'the|extended to|extensions of|extent of|extent permitted|extent such|extent that|f requiring|facilitating copying|facilities for|facilities provided|f'
        'ails to|failure of|fair use|family or|fashion requiring|favor of|feature that|fee 5|fee end|fee royalty|file should|file to|files a|files associated|f'
        'iles for|files or|finally terminates|find the|first please|first time|fitness for|fixed on|fixed term|flow between|follow a|follow terms|follow the|fo'
        'llowing notices|following paragraph|following the|following three|for a|for all|for an|for and|for any|for anyone|for as|for at|for communication|for '
        'copying|for damages|for details|for each|for enforcing|for example|for exercise|for further|for having|for incorporation|for infringement|for making|f'
        'or material|for more|for most|for patent|for personal|for publicity|for purposes|for running|for sale|for shared|for software|for that|for the|for the'
        'm|for this|for unpacking|for use|for which|for you|forbid circumvention|force you|form a|form and|form is|form means|form of|form under|format that|fo'
        'rms you|found one|foundation either|foundation if|foundation inc|foundation may|free copyleft|free of|free patent|free programs|free software|freedom '
        'if|freedom not|freedom to|from a|from an|from anti|from any|from conveying|from making|from one|from or|from other|from running|from that|from the|fro'
        'm those|from time|from you|fsf org|fulfilling obligations|full notice|functioning of|further charge|further conveying|further modification|further res'
        'triction|further restrictions|future versions|general public|general purpose|general special|generally available|generate install|get it|get your|give'
        ' all|give anyone|give appropriate|give the|give under|give you|given a|given its|given local|gives no|gives you|giving a|gnu affero|gnu general|gnu gp'
        'l|gnu lesser|gnu org|governed by|gpl see|grant a|grant is|grant patent|grant rights|grant such|granted for|granted or|granted prior|granted under|gran'
        'ts to|grants you|gratis or|greatest possible|guarantee your|gui interface|had or|has been|has interactive|has it|has substantial|have actual|have at|h'
        'ave been|have or|have permission|have reason|have received|have separately|have the|having copies|having them|hereafter acquired|holder and|holder as|'
        'holder explicitly|holder fails|holder is|holder notifies|holder or|holder who|holders and|holders of|hope that|hosts the|household purposes|how the|ho'
        'w they|how to|however denominated|however if|however it|however no|however nothing|https fsf|https www|hypothetical commands|idea of|identifiable pate'
        'nts|if a|if additional|if any|if authorized|if conditions|if it|if necessary|if neither|if not|if propagation|if pursuant|if such|if the|if this|if yo'
        'u|if your|implement a|implementation available|implementation is|implied including|implied license|implied warranties|implied warranty|import and|impo'
        'rting the|impose a|impose any|impose on|imposed on|in a|in accord|in an|in any|in certain|in connection|in conveying|in detail|in determining|in favor'
        '|in force|in interest|in new|in no|in object|in one|in or|in order|in performing|in perpetuity|in reasonable|in return|in rom|in section|in some|in so'
        'urce|in spirit|in that|in the|in this|in which|in writing|inability to|inaccurate or|inc https|incidental or|include a|include anything|include claims'
        '|include the|include within|included in|includes a|includes copying|includes interface|includes the|including a|including any|including but|including '
        'scripts|inclusion of|incorporated pursuant|incorporating your|incorporation into|indemnification of|independent works|indicate your|indicating where|i'
        'ndividual copies|individual works|individuals or|industrial or|inform other|information but|information does|information for|information must|informat'
        'ion on|information provided|information required|infringe copyright|infringe one|infringed by|infringed only|infringement that|infringement to|infring'
        'ement under|initiate litigation|install and|install modified|installation information|installed access|installed by|installed in|instead of|intact all'
        '|intended to|intention to|interacting with|interaction an|interaction make|interaction use|interaction with|interactive interfaces|interactive mode|in'
        'teractive user|interchange b|interchange for|interest had|interest if|interface definition|interface displays|interface for|interface means|interface '
        'presents|interface that|interface you|interfaces each|interfaces specified|interfaces that|interfered with|interpretation of|interpreter used|intimate'
        ' data|into a|into possession|into proprietary|into that|invalidate such|irrevocable provided|is a|is addressed|is allowed|is an|is any|is automaticall'
        'y|is available|is based|is called|is characterized|is combined|is conditioned|is covered|is discriminatory|is distributed|is effected|is either|is exc'
        'luded|is expected|is found|is free|is given|is governed|is in|is included|is incorporated|is infringed|is no|is normally|is not|is permitted|is public'
        'ly|is reinstated|is released|is safest|is specifically|is that|is the|is to|is transferred|is void|is what|is widely|is with|is without|it 11|it a|it '
        'additional|it and|it at|it contains|it d|it does|it free|it from|it has|it if|it in|it includes|it is|it more|it object|it on|it or|it output|it remai'
        'ns|it remotely|it starts|it such|it that|it the|it to|it under|it unnecessary|it will|it with|it you|item in|its conditions|its content|its contributo'
        'r|its corresponding|its coverage|its parts|its resulting|its users|itself materially|june 2007|keep intact|kernel window|key for|keys or|kind either|k'
        'ind of|kinds of|know you|knowingly relying|knowledge that|language one|language the|larger program|later license|later version|law 12|law except|law f'
        'or|law fulfilling|law if|law no|law or|law that|law you|laws prohibiting|laws that|lawsuit alleging|least the|least three|legal effect|legal notices|l'
        'egal permission|legal power|legal rights|lesser general|lgpl html|liability accompanies|liability differently|liability in|liability provided|liabilit'
        'y that|liability to|liable for|liable to|libraries and|libraries of|libraries or|library if|library need|library you|license 14|license a|license ackn'
        'owledges|license along|license an|license and|license any|license are|license as|license but|license by|license can|license copyright|license document'
        '|license does|license each|license explicitly|license fee|license for|license from|license gives|license grants|license if|license in|license includin'
        'g|license instead|license into|license is|license notwithstanding|license of|license on|license only|license or|license otherwise|license refers|licen'
        'se shall|license that|license the|license then|license therefore|license they|license through|license to|license under|license version|license version'
        's|license was|license which|license will|license with|license without|license would|license you|license your|licensed is|licensed under|licensee is|li'
        'censees and|licensees may|licenses also|licenses are|licenses for|licenses granted|licenses of|licenses protect|licenses the|licenses to|licenses why|'
        'licensing of|licensors and|licensors or|licensors to|like laws|like this|likewise does|limit operation|limit the|limitation of|limited to|limiting any'
        '|limiting liability|limiting the|line and|line to|link or|linked subprograms|linking proprietary|list meets|list of|litigation including|local law|loc'
        'al legal|long as|loss of|losses sustained|machine readable|made from|made if|mail if|maintain clear|major component|major essential|make it|make modif'
        'ications|make or|make payment|make run|make such|make sure|make them|make use|make you|makes it|making any|making available|making exceptions|making m'
        'odifications|making of|making or|making using|manner consistent|manner permitted|march 2007|marked in|marks or|masks the|material added|material be|ma'
        'terial by|material for|material governed|material or|material outside|material supplement|material under|material you|materially and|may add|may at|ma'
        'y be|may charge|may choose|may consider|may convey|may differ|may give|may if|may make|may not|may offer|may otherwise|may place|may publish|may remov'
        'e|meaning of|means a|means all|means an|means any|means copyright|means either|means of|means prior|means the|means then|means this|means to|means you'
        '|measure under|measures 4|measures to|measures when|medium accompanied|medium customarily|medium is|medium provided|meet all|meets this|menu a|merchan'
        'tability and|merchantability or|mere interaction|merging organizations|met this|methods procedures|might be|misrepresentation of|mode of|mode program|'
        'model to|modification follow|modification has|modification itself|modification making|modification of|modifications exclusively|modifications to|modif'
        'ied it|modified object|modified or|modified source|modified version|modified versions|modifies and|modifies the|modify a|modify and|modify any|modify '
        'it|modify or|modify the|modifying a|modifying or|more details|more identifiable|more information|more of|more than|more useful|moreover your|most clos'
        'ely|most effectively|most software|must be|must carry|must display|must do|must either|must license|must place|must prominently|must require|must suff'
        'ice|name and|name of|names of|names trademarks|nature extensions|necessary for|necessary servicing|need not|needed to|neither you|network correspondin'
        'g|network if|network interaction|network may|network or|network server|network with|new free|new licenses|new problems|new program|new programs|new ve'
        'rsions|next to|no additional|no case|no charge|no covered|no event|no further|no more|no permission|no price|no special|no surrender|no transfer|no wa'
        'rranty|non consumer|non exclusive|non exercise|non permissive|non source|noncommercially and|nor any|normal form|normally used|not accept|not allowed|'
        'not apply|not available|not be|not by|not cause|not combined|not control|not convey|not conveying|not display|not excuse|not impose|not include|not in'
        'itiate|not invalidate|not lgpl|not limited|not make|not part|not permanently|not permit|not price|not propagate|not qualify|not require|not required|n'
        'ot responsible|not see|not specify|not survive|not terminate|not to|not used|nothing in|nothing other|notice and|notice indicating|notice is|notice ke'
        'ep|notice like|notice of|notice stating|notice termination|notices c|notices displayed|notices however|notices of|notices or|notices stating|notices t'
        'o|notices your|notifies you|notify you|notwithstanding any|number if|number of|numbered version|object code|obligate you|obligated to|obligations are|'
        'obligations then|obligations under|occasionally and|occurring solely|occurs as|of a|of acceptance|of all|of an|of any|of author|of charge|of conveying'
        '|of copyright|of course|of coverage|of data|of distributing|of downstream|of each|of enforcing|of facilitating|of fair|of following|of free|of further'
        '|of having|of how|of interfaces|of it|of its|of liability|of licensors|of making|of merchantability|of names|of network|of one|of or|of others|of pack'
        'aging|of parties|of physically|of possession|of product|of propagation|of rights|of section|of sections|of software|of some|of source|of specified|of '
        'such|of technological|of terms|of that|of the|of these|of this|of use|of user|of using|of violation|of warranty|of what|of whether|of works|of your|of'
        'fer all|offer equivalent|offer for|offer in|offer spare|offer support|offer to|offer valid|offer you|offered to|offering access|offering for|official '
        'standard|on 20|on a|on any|on each|on how|on it|on material|on of|on terms|on the|on this|on those|on which|on you|on your|one line|one of|one or|one '
        'that|only as|only if|only occasionally|only significant|only to|only way|operate with|operated by|operating system|operation of|operation or|opportuni'
        'ty to|option any|option of|option remove|options such|or 2|or 3|or a|or adapt|or affirmed|or agreed|or an|or any|or arrangement|or assumption|or at|or'
        ' author|or authors|or b|or c|or can|or combine|or commitment|or common|or compilations|or concerns|or consequential|or control|or controlled|or convey'
        '|or conveying|or conveys|or copies|or copying|or copyright|or correction|or could|or counterclaim|or covenant|or customary|or customer|or d|or data|or'
        ' different|or distribution|or e|or embodied|or expects|or f|or fitness|or for|or from|or general|or generally|or hereafter|or household|or implied|or '
        'importing|or in|or inability|or installed|or interfered|or is|or key|or legal|or limiting|or losses|or merging|or modification|or modified|or modify|o'
        'r modifying|or more|or new|or no|or non|or of|or on|or options|or organizations|or other|or otherwise|or part|or propagate|or propagating|or provide|o'
        'r receive|or requiring|or restricting|or rights|or run|or running|or school|or secondarily|or selling|or service|or similar|or sold|or specifically|or'
        ' stated|or subdividing|or substantially|or that|or the|or third|or to|or updates|or use|or violates|or warranty|or with|or without|or your|order agree'
        'ment|order to|org everyone|org licenses|organization or|organizations if|organizations to|origin of|original licensors|original version|other activiti'
        'es|other charge|other circumstances|other defenses|other equivalent|other information|other kinds|other non|other parties|other parts|other party|othe'
        'r peers|other pertinent|other practical|other programs|other provision|other readily|other separate|other than|other way|others for|others freedom|oth'
        'erwise be|otherwise remains|otherwise run|otherwise stated|otherwise that|otherwise to|our general|out of|output a|output from|output given|outside th'
        'eir|own removal|owned or|packaged this|packaging a|paper mail|paragraph notwithstanding|paragraph of|paragraph plus|paragraphs a|part may|part of|part'
        ' which|particular copyright|particular product|particular programming|particular purpose|particular user|particular work|parties legal|parties or|part'
        'ies provide|parties receiving|parties to|parties who|parties with|parts of|parts or|parts regardless|party based|party grants|party has|party if|party'
        ' means|party retains|party s|party that|party to|party who|password or|patent against|patent claim|patent claims|patent infringement|patent law|patent'
        ' license|patent licenses|patent or|patent sublicenses|patent such|patents a|patents in|payment to|peer to|peer transmission|peers where|performance of'
        '|performing this|performing those|permanently authorizes|permanently if|permanently reinstated|permission if|permission notwithstanding|permission oth'
        'er|permission to|permission would|permissions all|permissions apply|permissions are|permissions but|permissions from|permissions however|permissions m'
        'ay|permissions on|permissions that|permissions when|permissive additional|permissive may|permissive or|permissive terms|permit inclusion|permit incorp'
        'orating|permit linking|permits relicensing|permitted above|permitted by|permitted solely|permitted to|perpetuity or|personal family|personal property|'
        'pertinent obligations|physical distribution|physical medium|physical product|physically performing|pieces of|place additional|place at|place gratis|pl'
        'ace in|place to|please read|plus a|pointer to|portion of|possesses the|possession and|possession of|possibility of|possible use|power to|practical wor'
        'ks|practice a|preamble the|precise terms|predecessor has|predecessor in|preferred form|present version|presents a|preservation of|prevented or|previou'
        's paragraph|price for|price no|price or|price our|primarily for|prior to|private copy|problems or|procedures authorization|procuring conveyance|produc'
        'e it|produce the|product a|product and|product doubtful|product for|product from|product has|product in|product including|product installation|product'
        ' is|product means|product model|product received|product regardless|product that|product which|products or|program 13|program ancillary|program and|pr'
        'ogram as|program comes|program copyright|program does|program has|program if|program in|program including|program into|program is|program it|program l'
        'ater|program or|program prove|program refers|program remains|program s|program shall|program specifies|program that|program the|program to|program unl'
        'ess|program you|program your|programmer or|programming language|programs and|programs even|programs if|programs which|prohibit them|prohibiting misrep'
        'resentation|prohibiting or|prohibits the|prominent item|prominent notices|prominently offer|prominently visible|propagate a|propagate by|propagate cov'
        'ered|propagate modify|propagate or|propagate that|propagate the|propagating a|propagation includes|propagation of|propagation that|property which|prop'
        'rietary applications|proprietary programs|protect your|protecting users|protection for|protocols for|prove defective|provide installation|provide supp'
        'ort|provide the|provide you|provided above|provided by|provided in|provided that|provided the|provided under|provided you|providing access|provision o'
        'f|provisionally unless|proxy can|proxy s|public and|public at|public in|public license|public licenses|public statement|public the|publicity purposes|'
        'publicly available|publicly documented|publish on|publish revised|published by|purpose of|purpose see|purpose the|purpose tools|purposes of|purposes o'
        'r|pursuant to|qualify to|quality and|read https|readable corresponding|readily accessible|reading or|reason to|reasonable cost|reasonable efforts|reas'
        'onable legal|reasonable means|reasonable ways|receipt of|receive a|receive copies|receive it|receive new|receive or|receive source|receive the|receive'
        'd a|received by|received copies|received it|received notice|received the|receives a|receives whatever|receiving the|recipient automatically|recipient '
        'for|recipient in|recipient or|recipient s|recipients a|recipients each|recipients knowingly|recipients may|recipients of|recipients to|recognized stan'
        'dards|redistribute and|redistribute it|referring to|refers to|refrain entirely|regard to|regardless of|regenerate automatically|reinstated a|reinstate'
        'd permanently|reinstated you|relationship with|released under|relevant date|relevant source|relicensing or|relying means|relying on|remain governed|re'
        'main obligated|remains free|remains governed|remains in|remote network|remotely through|removal in|remove any|remove that|rendered inaccurate|repair o'
        'r|represent the|require acceptance|require no|require recipients|require such|require their|required by|required for|required to|requirement does|requ'
        'irement in|requirement modifies|requirement to|requirements apply|requirements e|requirements of|requiring copyright|requiring indemnification|requiri'
        'ng preservation|requiring that|resolved in|respect to|responsible for|restricting circumvention|restriction but|restriction does|restriction you|restr'
        'ictions on|restrictions within|result of|resulting copyright|resulting work|results from|retains the|return for|reviewing courts|revised and|revised v'
        'ersions|right of|right to|rights from|rights granted|rights have|rights of|rights that|rights to|rights under|rights with|risk as|rom the|royalty for|'
        'royalty free|royalty or|rules and|run a|run and|run it|run modify|run the|running a|running the|running those|runs or|s commands|s contributor|s essen'
        'tial|s name|s predecessor|s public|s source|s system|s use|s users|safest to|sale import|sale or|same material|same place|same way|same work|satisfy b'
        'oth|satisfy simultaneously|satisfy these|saying where|school if|scope of|scripts to|secondarily liable|section 10|section 11|section 4|section 7|secti'
        'on does|section in|section must|section you|sections 15|sections 4|see https|see the|sell offer|selling its|selling offering|semiconductor masks|separ'
        'able portion|separate and|separately received|separately under|separately written|server at|server hosts|server operated|server or|server software|ser'
        'ver the|serves only|service marks|service warranty|servicing repair|shall apply|shall be|shall include|share and|shared libraries|short notice|should '
        'also|should have|should show|should the|show c|show the|show w|sign a|significant mode|similar in|similar laws|simultaneously your|single combined|sin'
        'gle transaction|so 10|so a|so as|so attach|so available|so exclusively|so long|so on|software and|software for|software foundation|software in|softwar'
        'e interchange|software or|software the|software this|software under|software we|software which|software you|sold for|sole purpose|solely as|solely bec'
        'ause|solely under|some countries|some manner|some of|some reasonable|some standard|some trade|source along|source as|source code|source conveyed|sourc'
        'e file|source files|source fixed|source for|source form|source forms|source from|source in|source includes|source may|source need|source of|source or|'
        'source regardless|source shall|source the|source this|source to|source under|source versions|source you|spare parts|speak of|special incidental|specia'
        'l password|specific copy|specific operating|specific products|specifically designed|specifically for|specifically granted|specified for|specified reas'
        'onable|specifies that|specify a|spirit to|standard defined|standard interface|standard or|standards body|start of|starts in|state the|stated as|stated'
        ' below|stated conditions|stated in|statement of|stating that|status of|steps 1|storage or|subdividing an|subject to|sublicenses in|sublicensing is|sub'
        'programs and|subprograms that|subroutine library|subsection 6b|subsection 6d|substantial commercial|substantially all|such a|such an|such as|such circ'
        'umvention|such damages|such holder|such interaction|such material|such measures|such new|such permission|such relicensing|such uses|sue for|suffice to'
        '|supplement the|support for|support or|support service|supports equivalent|supports such|sure it|sure that|surrender of|survive such|sustained by|syst'
        'em and|system if|system libraries|system library|take away|tangible personal|technological measure|technological measures|tells the|term if|term of|te'
        'rm regardless|term that|terminal interaction|terminate the|terminate your|terminated and|terminates your|termination of|termination you|terms a|terms '
        'added|terms additional|terms and|terms are|terms of|terms permissive|terms reviewing|terms that|terms to|than the|than this|than your|that 1|that a|th'
        'at any|that apply|that are|that arrangement|that but|that class|that contain|that contradict|that copy|that copyright|that country|that do|that either'
        '|that enables|that has|that is|that it|that language|that license|that licensees|that major|that material|that may|that modified|that most|that number'
        'ed|that obligate|that part|that patent|that product|that prohibit|that proxy|that same|that supplement|that supports|that term|that the|that there|tha'
        't these|that they|that this|that transaction|that use|that user|that users|that version|that warranties|that without|that work|that would|that you|the'
        ' ability|the above|the absence|the access|the additional|the aggregate|the applicable|the appropriate|the benefit|the best|the business|the case|the c'
        'essation|the code|the community|the compilation|the conditions|the contents|the continued|the contributor|the conveying|the copyright|the correspondin'
        'g|the cost|the covered|the disclaimer|the earlier|the entire|the exclusion|the executable|the exercise|the extent|the first|the following|the form|the'
        ' free|the freedom|the full|the further|the general|the gnu|the greatest|the hope|the hypothetical|the implied|the individual|the information|the insta'
        'llation|the interface|the library|the license|the licenses|the list|the machine|the making|the material|the meaning|the modification|the modifications'
        '|the modified|the network|the non|the normal|the notice|the object|the only|the operation|the option|the origin|the original|the other|the output|the '
        'part|the particular|the parties|the party|the patent|the place|the possibility|the precise|the predecessor|the preferred|the present|the previous|the '
        'product|the program|the public|the quality|the recipient|the relevant|the requirement|the requirements|the resulting|the right|the rights|the rules|th'
        'e same|the scope|the software|the sole|the source|the specific|the start|the stated|the status|the system|the term|the terms|the third|the transaction'
        '|the unmodified|the use|the user|the violation|the way|the whole|the wipo|the work|the works|the written|their nature|their own|their relationship|the'
        'ir terms|them do|them from|them if|them make|them to|then as|then the|then you|then your|there is|therefore apply|therefore by|these actions|these con'
        'ditions|these contractual|these requirements|these terms|these things|these ways|they are|they do|they were|things developers|third paragraph|third pa'
        'rties|third party|this alternative|this and|this context|this conveying|this corresponding|this criterion|this definition|this is|this license|this pa'
        'rticular|this program|this requirement|this section|this when|those activities|those copies|those files|those licensors|those permissions|those subpro'
        'grams|those terms|those thus|those to|those works|though they|three paragraphs|three years|through a|through some|through the|thus licensed|thus makin'
        'g|time such|time to|time you|to 28|to 30|to 60|to a|to accept|to achieve|to address|to all|to an|to any|to anyone|to apply|to attach|to be|to believe|'
        'to choose|to collect|to contact|to continue|to control|to convey|to copy|to deprive|to distribute|to do|to downstream|to enable|to enforce|to ensure|t'
        'o extend|to find|to follow|to forbid|to form|to freedom|to generate|to give|to grant|to guarantee|to implement|to in|to infringement|to install|to it|'
        'to keep|to license|to limit|to link|to loss|to make|to modify|to most|to notify|to operate|to or|to other|to others|to part|to peer|to permit|to posse'
        'ssion|to practice|to produce|to propagate|to provide|to receive|to redistribute|to refrain|to require|to run|to satisfy|to share|to sign|to some|to su'
        'e|to take|to terms|to that|to the|to their|to this|to those|to time|to use|to version|to view|to where|to whom|to you|to your|tools or|trade names|tra'
        'demark law|trademarks or|transaction each|transaction in|transaction is|transaction or|transaction transferring|transaction who|transfer of|transferre'
        'd to|transferring control|transmission provided|transmission to|treated as|treaty adopted|two steps|type show|typical or|under any|under applicable|un'
        'der article|under certain|under section|under subsection|under the|under these|under this|under those|under trademark|under version|under which|under '
        'your|unless a|unless and|unless required|unless such|unless you|unlimited permission|unmodified in|unmodified program|unnecessary 3|unpacking reading|'
        'until the|updates for|use an|use for|use in|use of|use or|use our|use pieces|use propagate|use sell|use the|use to|use under|use with|used among|used '
        'for|used refers|used separately|used that|used to|used unmodified|useful but|useful to|user actually|user commands|user interface|user interfaces|user'
        ' normally|user or|user product|user that|user through|users beyond|users can|users interacting|users legal|users when|users your|uses or|uses represen'
        't|uses unless|using or|using peer|using selling|valid for|valid if|valid under|verbatim copies|version 15|version 3|version a|version applies|version '
        'but|version by|version ever|version for|version in|version is|version must|version number|version of|version or|version permanently|version published|'
        'version supports|version this|versions may|versions of|versions will|versions you|view a|violates the|violation by|violation of|violation prior|visibl'
        'e feature|void and|volume of|w and|w this|waive any|waiver of|want it|want to|warranties are|warranties of|warranty and|warranty for|warranty of|warra'
        'nty or|warranty protection|warranty there|warranty without|was granted|way 8|way but|way in|way through|way to|way you|ways a|ways as|we are|we speak|'
        'welcome to|well to|were included|what it|what server|what the|what you|whatever licenses|when it|when otherwise|when the|when we|when you|where the|wh'
        'ere to|whether a|whether already|whether by|whether the|which an|which are|which everyone|which future|which gives|which is|which it|which means|which'
        ' the|which you|who authorizes|who comes|who conveys|who have|who modifies|who possesses|who receives|who would|whole of|whole that|whole under|whom yo'
        'u|whose source|why not|widely used|will any|will automatically|will be|will continue|will remain|will therefore|window system|wipo copyright|wish that'
        '|with a|with absolutely|with an|with any|with contractual|with copies|with facilities|with it|with no|with or|with other|with reasonable|with respect|'
        'with section|with solely|with source|with specific|with subsection|with such|with terms|with that|with the|with this|with two|with which|with you|with'
        'in the|without any|without conditions|without even|without modification|without permission|without regard|without warranty|work 2|work a|work also|wor'
        'k and|work are|work as|work authorizing|work based|work but|work conveyed|work covered|work except|work for|work from|work has|work if|work in|work in'
        'clude|work including|work is|work knowingly|work licensed|work material|work means|work must|work need|work occurring|work on|work or|work results|wor'
        'k run|work runs|work s|work shall|work so|work subject|work that|work the|work then|work these|work this|work thus|work under|work unless|work with|wo'
        'rk you|working in|works are|works based|works by|works containing|works for|works permit|works provided|works specifically|works such|works that|works'
        ' to|works which|worldwide royalty|would be|would infringe|would make|would receive|would use|writing the|writing will|written license|written offer|wr'
        'itten to|www gnu|year name|years and|you a|you add|you additional|you agree|you also|you are|you assume|you by|you can|you cannot|you cease|you comply'
        '|you conspicuously|you convey|you conveying|you could|you cure|you develop|you directly|you disclaim|you do|you entered|you for|you from|you grant|you'
        ' have|you indicate|you inform|you know|you legal|you licensees|you maintain|you make|you may|you modified|you modify|you must|you need|you nor|you of|'
        'you offer|you or|you permission|you receive|you received|you remain|you should|you this|you to|you under|you waive|you want|you whether|you wish|you w'
        'ith|you work|you would|your acceptance|your activity|your behalf|your choosing|your conveying|your copyrighted|your direction|your employer|your freed'
        'om|your license|your modified|your new|your obligations|your option|your or|your program|your reasonable|your receipt|your recipient|your rights|your '
        'unlimited|your version|your work|yourself of'
    ),
    'Apache-2.0#text': (
        '0 january|0 the|0 unless|1 definitions|1 through|2 0|2 grant|2004 http|3 grant|4 redistribution|5 submission|50 or|6 trademarks|7 disclaimer|8 limitat'
        'ion|9 accepting|9 of|a contribution|a copy|a copyright|a cross|a display|a fee|a file|a lawsuit|a notice|a particular|a perpetual|a readable|a result|'
        'a source|a whole|a you|above nothing|acceptance of|accepting any|accepting such|accepting warranty|act only|acting entity|acts or|add your|addendum to'
        '|additional attribution|additional liability|additional or|additional terms|additions to|advised of|against any|against such|agree to|agreed to|agreem'
        'ent you|all copyright|all other|alleging that|alone or|along with|alongside or|also recommend|an addendum|an as|an example|an individual|an original|a'
        'nd all|and any|and assume|and attribution|and b|and c|and charge|and conditions|and configuration|and conversions|and customary|and d|and derivative|a'
        'nd description|and distribute|and distribution|and do|and each|and for|and grossly|and hold|and improving|and in|and issue|and limitations|and may|and'
        ' on|and only|and or|and otherwise|and reproducing|and subsequently|and such|and under|and wherever|annotations elaborations|any additional|any and|any'
        ' character|any contribution|any contributor|any derivative|any direct|any entity|any form|any individual|any kind|any liability|any medium|any modific'
        'ations|any modified|any other|any part|any patent|any risks|any separate|any such|any warranties|any work|apache license|apache org|appear the|appendi'
        'x below|appendix how|applicable law|applies only|apply the|appropriate comment|appropriateness of|archives copyright|are controlled|are for|are manage'
        'd|are necessarily|are solely|are under|arising as|as a|as an|as defined|as deliberate|as indicated|as is|as modifying|as not|as of|as part|as required'
        '|as stated|as the|asserted against|associated with|assume any|at http|at least|attach the|attached to|attribution notices|authorized by|authorized to|'
        'authorship for|authorship including|authorship whether|available under|b you|based on|basis without|be construed|be enclosed|be included|be liable|be '
        'under|been advised|been received|behalf and|behalf of|below derivative|beneficial ownership|bind by|boilerplate notice|brackets replaced|brackets the|'
        'but excluding|but not|by a|by an|by applicable|by brackets|by combination|by contract|by licensor|by name|by or|by reason|by sections|by such|by the|b'
        'y their|by this|by you|c you|cannot be|carry prominent|cause any|cause the|changed the|character arising|charge a|charge royalty|choose to|claim or|cl'
        'aims asserted|claims licensable|class name|code control|code documentation|code generated|combination of|comment syntax|commercial damages|common cont'
        'rol|communication on|communication sent|communication that|compiled object|compliance with|complies with|computer failure|conditions a|conditions appe'
        'ndix|conditions for|conditions notwithstanding|conditions of|conditions stated|configuration files|consequential damages|consistent with|conspicuously'
        ' marked|constitutes direct|construed as|contained within|content of|contents of|contract or|contribution contributor|contribution has|contribution inc'
        'orporated|contribution intentionally|contribution s|contribution shall|contributions 6|contributions on|contributions unless|contributor and|contribut'
        'or be|contributor by|contributor harmless|contributor has|contributor hereby|contributor provides|contributor shall|contributor that|contributory pate'
        'nt|control are|control means|control systems|control with|controlled by|conversions to|copies of|copy of|copyright license|copyright notice|copyright '
        'owner|copyright patent|copyright statement|copyright yyyy|counterclaim in|cross claim|customary use|d if|damages 9|damages for|damages including|damag'
        'es of|damages or|date such|defend and|defined by|definition control|definition submitted|definitions license|deliberate and|derivative works|derived f'
        'rom|describing the|description of|designated in|determining the|different license|direct indirect|direct or|direction or|disclaimer of|discussing and|'
        'display generated|display publicly|distribute all|distribute alongside|distribute copies|distribute must|distribute the|distributed as|distributed on|'
        'distributed under|distribution 1|distribution as|distribution of|distribution then|do not|document licensor|documentation and|documentation if|documen'
        'tation source|does not|don t|each contributor|easier identification|editorial revisions|either express|elaborations or|electronic mailing|electronic v'
        'erbal|enclosed by|enclosed in|end of|entities that|entity and|entity authorized|entity exercising|entity for|entity including|entity on|entity shall|e'
        'ntity whether|entity you|even if|event and|example is|except as|except in|excluding communication|excluding those|exclusive no|executed with|exercise '
        'of|exercising permissions|explicitly state|express or|failure or|fee for|fields enclosed|fifty percent|file 7|file are|file as|file distributed|file e'
        'xcept|file excluding|file format|file or|filed 4|files and|files object|files to|fitness for|following boilerplate|following conditions|following plac'
        'es|for a|for acceptance|for any|for damages|for determining|for easier|for inclusion|for informational|for loss|for making|for reasonable|for that|for'
        ' the|for use|for which|form 3|form for|form including|form made|form of|form or|form provided|form resulting|form shall|form that|format we|free irrev'
        'ocable|from mechanical|from or|from the|generated by|generated documentation|give any|goodwill work|governing permissions|grant of|grant permission|gr'
        'anted by|granted to|granting the|grants to|grossly negligent|harmless for|has been|have executed|have made|hereby grants|herein shall|hold each|how to'
        '|however in|http www|i the|identification within|identifying information|if and|if provided|if such|if the|if you|ii ownership|iii beneficial|implied '
        'including|implied see|import and|improving the|in a|in accepting|in any|in at|in compliance|in describing|in no|in or|in source|in the|in this|in tort'
        '|in writing|inability to|incidental or|include a|include the|include works|included in|included on|includes a|including a|including any|including but|'
        'including negligence|including the|including without|inclusion in|incorporated within|incurred by|indemnify defend|indemnity or|indicated by|indirect '
        'special|indirect to|individual or|information don|informational purposes|infringed by|infringement merchantability|infringement then|institute patent|'
        'intentionally submitted|interfaces of|irrevocable copyright|irrevocable except|is based|is basis|is conspicuously|is distributed|is filed|is granting|'
        'is included|is intentionally|is provided|issue tracking|its contributions|its distribution|its representatives|january 2004|kind either|language gover'
        'ning|law or|law such|lawsuit alleging|least one|legal entity|legal theory|liability end|liability in|liability incurred|liability obligations|liabilit'
        'y while|liable to|licensable by|license 2|license 5|license 8|license agreement|license and|license applies|license as|license at|license derivative|l'
        'icense does|license each|license for|license however|license is|license legal|license or|license shall|license source|license subject|license terms|li'
        'cense to|license version|license without|license you|licensed under|licenses granted|licenses license|licenses terms|licensor and|licensor except|lice'
        'nsor for|licensor or|licensor provides|licensor regarding|licensor shall|limitation any|limitation of|limitations under|limited to|link or|lists sourc'
        'e|litigation against|litigation is|loss of|losses even|made available|made use|mailing lists|make have|making modifications|malfunction or|managed by|'
        'management of|marked or|marks or|may act|may add|may choose|may have|may not|may obtain|may provide|may reproduce|mean an|mean any|mean licensor|mean '
        'the|means any|means i|mechanical transformation|media types|medium with|meet the|merchantability or|merely link|modifications and|modifications includ'
        'ing|modifications or|modifications represent|modified files|modify the|modifying the|more of|must cause|must give|must include|must retain|name and|na'
        'me of|name to|names of|names trademarks|necessarily infringed|negligence contract|negligent acts|no charge|no event|no legal|non exclusive|non infring'
        'ement|normally appear|not a|not grant|not include|not limited|not modify|not on|not pertain|not use|nothing herein|notice file|notice for|notice text|'
        'notice that|notice with|notices cannot|notices contained|notices from|notices normally|notices stating|notices that|notices within|notwithstanding the'
        '|object code|object form|obligations and|obligations you|obtain a|of a|of any|of authorship|of contributions|of copyright|of discussing|of electronic|'
        'of fifty|of goodwill|of its|of liability|of patent|of permissions|of publicly|of purpose|of such|of support|of terms|of the|of their|of this|of title|'
        'of using|of warranty|of whom|of your|offer and|offer to|on an|on behalf|on electronic|on or|on the|on your|one of|only and|only if|only on|only to|or '
        'a|or additional|or additions|or agreed|or any|or are|or as|or attached|or bind|or by|or claims|or class|or conditions|or consequential|or contributory'
        '|or counterclaim|or derivative|or derived|or different|or distribution|or documentation|or entity|or fitness|or for|or ii|or iii|or implied|or inabili'
        'ty|or indirect|or its|or legal|or losses|or malfunction|or management|or merely|or modify|or more|or object|or on|or other|or otherwise|or out|or prod'
        'uct|or redistributing|or rights|or translation|or within|or without|or written|or your|org licenses|origin of|original version|original work|other com'
        'mercial|other contributor|other entities|other liability|other media|other modifications|other recipients|otherwise any|otherwise complies|otherwise d'
        'esignated|otherwise or|otherwise transfer|otherwise unless|out of|outstanding shares|own attribution|own behalf|own copyright|own identifying|owner as'
        '|owner for|owner licensed|owner or|owner that|ownership of|page as|part of|particular purpose|party archives|party notices|patent claims|patent infrin'
        'gement|patent license|patent licenses|patent litigation|patent trademark|percent 50|perform sublicense|permission to|permissions and|permissions grant'
        'ed|permissions under|perpetual worldwide|pertain to|places within|possibility of|power direct|preferred form|prepare derivative|printed page|product n'
        'ames|prominent notices|provide additional|provided along|provided in|provided that|provided your|provides its|provides the|publicly display|publicly p'
        'erform|purpose be|purpose of|purpose you|purposes of|purposes only|readable copy|reason of|reasonable and|received by|recipients of|recommend that|red'
        'istributing the|redistribution you|regarding such|remain separable|replaced with|represent as|representatives including|reproduce and|reproduce prepar'
        'e|reproducing the|reproduction and|reproduction or|required by|required for|responsibility not|responsible for|result of|resulting from|retain in|revi'
        'sions annotations|rights consistent|risks associated|royalty free|s alone|s was|s with|same printed|section patent|sections 1|see the|sell import|sell'
        ' sell|sent to|separable from|separate license|service marks|shall any|shall be|shall mean|shall not|shall supersede|shall terminate|shares or|should b'
        'e|software distributed|software source|sole responsibility|solely responsible|source and|source code|source form|source or|special incidental|specific'
        ' language|state otherwise|stated in|statement to|stating that|stoppage computer|subject to|sublicense and|submission of|submit on|submitted for|submit'
        'ted if|submitted means|submitted to|subsequently incorporated|such additional|such as|such contribution|such contributions|such contributor|such damag'
        'es|such derivative|such entity|such license|such litigation|such notice|such obligations|such third|such warranty|supersede or|support warranty|syntax'
        ' for|systems and|systems that|t include|terminate as|terms and|terms of|terms or|text file|text from|text should|that a|that are|that control|that do|'
        'that entity|that is|that remain|that such|that the|that work|that you|the above|the acting|the apache|the appendix|the appropriate|the appropriateness'
        '|the attribution|the brackets|the conditions|the content|the contents|the copyright|the date|the derivative|the direction|the editorial|the fields|the'
        ' file|the files|the following|the interfaces|the license|the licensor|the notice|the origin|the original|the outstanding|the possibility|the power|the'
        ' preferred|the purpose|the purposes|the same|the source|the specific|the terms|the text|the trade|the union|the use|the work|their contribution|then a'
        'ny|theory whether|thereof contribution|thereof in|thereof that|thereof you|third party|this definition|this document|this file|this license|this secti'
        'on|those notices|those patent|through 9|title non|to any|to apply|to carry|to cause|to communication|to compiled|to damages|to in|to indemnify|to lice'
        'nsor|to make|to offer|to other|to reproduce|to sell|to software|to submit|to that|to the|to those|to use|to which|to you|to your|tort including|tracki'
        'ng systems|trade names|trademark and|trademarks service|trademarks this|transfer the|transformation or|translation of|types work|under common|under no'
        '|under the|under this|union of|unless required|unless you|use in|use offer|use or|use reproduction|use the|use this|using or|verbal or|version 2|versi'
        'on of|warranties or|warranty indemnity|warranty or|warranty unless|was submitted|we also|where such|wherever such|whether by|whether in|which such|whi'
        'ch the|while redistributing|whole an|whole provided|whom a|with licensor|with or|with that|with the|with this|with your|within a|within derivative|wit'
        'hin such|within the|within third|without any|without limitation|without modifications|without warranties|work 2|work an|work and|work attach|work but|'
        'work by|work constitutes|work excluding|work includes|work including|work of|work or|work otherwise|work provided|work shall|work stoppage|work to|wor'
        'k where|work whether|works a|works and|works as|works if|works in|works of|works or|works shall|works that|works thereof|works within|worldwide non|wr'
        'iting by|writing licensor|writing shall|writing software|written communication|www apache|you a|you agree|you are|you changed|you distribute|you expli'
        'citly|you for|you institute|you may|you meet|you must|you or|you to|you under|your accepting|your exercise|your modifications|your own|your shall|your'
        ' sole|your use|your work|yyyy name'
    ),
    'Artistic-1.0#text': (
        '1 you|10 this|2 you|3 and|3 you|4 provided|4 you|5 you|6 provided|6 the|7 c|8 aggregation|9 the|a binary|a commercial|a distribute|a distribution|a fe'
        'e|a larger|a major|a market|a mere|a more|a package|a particular|a place|a product|a prominent|a reasonable|a separate|a standard|a way|about copying|'
        'accompany the|accordance with|advertise this|aggregate with|aggregated with|aggregation of|aggregation provided|all of|allowing the|also be|also means'
        '|always permitted|an equivalent|an executable|an image|and 4|and associated|and clearly|and derivatives|and distribute|and fitness|and give|and librar'
        'y|and linked|and may|and other|and provide|and provided|and so|and variables|and when|and without|any distribution|any express|any fee|any non|any way'
        '|apply bug|archive site|are aggregated|are the|arrangements with|artistic control|artistic license|as a|as by|as in|as input|as is|as output|as part|a'
        's specified|as uunet|associated disclaimers|at large|at least|attempt is|automatically fall|available means|available such|away verbatim|b accompany|b'
        ' use|basis of|be aggregated|be considered|be construed|be copied|be fees|be provided|be required|be sold|be used|bear the|been modified|belong to|belo'
        'w copyright|binary executable|bug fixes|but are|but belong|but only|by allowing|by linking|by posting|by the|by this|by you|c give|c rename|c subrouti'
        'nes|called undump|can justify|cause it|change the|changed file|changed that|charge a|charge any|charged for|charges time|choose for|clearly document|c'
        'learly documents|code or|collection of|commercial distribution|commercial programs|commercial software|commercially and|community at|comparably compil'
        'ed|compiled subroutines|complete standard|computing community|conditions they|conditions under|conflict with|considered part|considered the|construed '
        'as|control over|copied such|copies of|copy of|copying fee|copying or|copyright holder|copyright notices|copyright of|copyright or|copyrights for|corpo'
        'ration or|cost duplication|created through|customary fashion|d make|defined by|definitions package|derivatives of|derived from|development of|differen'
        'ces in|differs from|disclaimers 2|distribute a|distribute the|distribute this|distributed by|distributing this|distribution arrangements|distribution '
        'is|distribution of|distribution provided|distribution such|distribution with|do at|do not|document is|document the|documents how|domain or|duplicate a'
        'll|duplication charges|each changed|each non|embed this|embedded 6|embedded that|emulate subroutines|end user|endorse or|equivalent medium|equivalent '
        'of|equivalent on|equivalent together|executable form|executable image|executable of|executable that|executables and|executables non|executables so|exe'
        'cutables which|express or|fail the|fall under|fashion plus|fee for|fee freely|fee is|fee you|fees involved|file and|file stating|files are|files creat'
        'ed|files distributed|files supplied|files together|fitness for|fixes and|fixes portability|following a|for a|for any|for each|for support|for the|for '
        'this|form of|form provided|freely available|from the|from this|generated them|get the|give away|give non|giving the|handling the|has been|has not|hold'
        'er 4|holder 5|holder a|holder and|holder as|holder but|holder is|holder maintains|holder may|holder to|how and|how it|however you|if it|if such|if you'
        '|image as|image shall|image then|implied warranties|in a|in accordance|in aggregate|in any|in each|in handling|in manual|in object|in order|in other|i'
        'n paragraph|in such|in the|include your|including without|input as|input to|insert a|instructions in|instructions on|intent of|interfaces visible|inte'
        'rpreter is|interpreter within|into this|involved and|involved in|is always|is and|is charged|is embedded|is made|is named|is provided|is so|is to|is w'
        'hatever|is when|is whoever|is you|it 1|it also|it differs|it fall|it has|it to|it under|item it|item itself|item may|itself however|itself though|just'
        'ify it|justify on|language 8|language defined|language in|languages supplied|large as|larger possibly|least one|less customary|library files|license p'
        'reamble|limitation the|linked into|linking this|machine readable|made to|maintains some|major archive|make and|make other|make reasonable|make them|ma'
        'ke this|manual page|manual pages|market that|may apply|may be|may charge|may distribute|may embed|may make|may not|may otherwise|may redistribute|mean'
        's that|media cost|medium or|merchantibility and|mere form|methods of|modification standard|modifications c|modifications definitions|modifications der'
        'ived|modifications in|modifications on|modifications to|modified in|modified or|modified package|modify your|more or|must also|must bear|name of|named'
        ' in|names and|names do|neither be|net or|no fee|no overt|non standard|nor shall|not advertise|not automatically|not be|not been|not change|not charge|'
        'not conflict|not represent|notice in|notices and|object code|of a|of aggregation|of artistic|of files|of input|of media|of merchantibility|of paragrap'
        'hs|of people|of producing|of such|of that|of the|of this|of your|of yours|on a|on the|on where|on you|one of|only to|only within|or an|or by|or compar'
        'ably|or copyrights|or distributing|or equivalent|or executable|or from|or has|or implied|or less|or library|or organization|or otherwise|or placing|or'
        ' produced|or promote|or unexec|order to|organization c|original copyright|other distribution|other languages|other modifications|other possibly|otherw'
        'ise make|otherwise modify|output from|over the|overt attempt|own you|package 7|package 9|package as|package b|package but|package do|package if|packag'
        'e in|package is|package itself|package may|package modified|package nor|package only|package reasonable|package refers|package s|package shall|package'
        ' the|package via|package while|package with|package without|package you|page for|page or|pages or|paragraph 6|paragraphs 3|part of|particular purpose|'
        'people involved|permission 10|permitted provided|place your|placing the|plus the|portability fixes|possibly commercial|posting said|preamble the|prior'
        ' written|produced as|producing a|product of|products derived|programs as|programs of|prominent notice|promote products|provide a|provided and|provided'
        ' as|provided that|provided these|public domain|purpose the|re thinking|readable source|reasonable copying|reasonable modifications|received it|recipie'
        'nts of|redistribute it|refers to|regression tests|rename any|represent such|required to|restriction provided|restrictions of|right to|s interfaces|s i'
        'nterpreter|said modifications|same conditions|scripts and|scripts or|semblance of|separate manual|shall be|shall it|shall neither|shall not|shall stil'
        'l|site such|so called|so embedded|so on|so the|software distribution|software without|sold commercially|some semblance|source form|source of|specific '
        'prior|specified below|standard executable|standard executables|standard names|standard version|state the|stating how|still be|subroutines and|subrouti'
        'nes do|subroutines in|subroutines or|such a|such an|such as|such scripts|such that|such use|supplied as|supplied by|support of|tests for|textual modif'
        'ication|that clearly|that collection|that file|that is|that must|that no|that recipients|that the|that would|that you|the artistic|the basis|the colle'
        'ction|the commercial|the complete|the computing|the conditions|the copyright|the development|the differences|the distribution|the end|the equivalent|t'
        'he executables|the fee|the following|the implied|the intent|the interpreter|the item|the language|the machine|the manual|the modifications|the modifie'
        'd|the name|the names|the original|the package|the programs|the public|the regression|the restrictions|the right|the same|the scripts|the so|the source'
        '|the standard|the use|the users|the wishes|them and|them freely|then distribution|there may|these subroutines|they received|thinking about|this docume'
        'nt|this package|this shall|this software|though there|through textual|time of|to emulate|to endorse|to fail|to get|to include|to justify|to make|to or'
        '|to state|to such|to the|to use|to usenet|to whoever|together with|under the|under which|undump or|unexec methods|use and|use of|use shall|use the|use'
        'd to|usenet or|user of|users of|uu net|uunet uu|variables of|verbatim copies|version 3|version b|version d|version of|version refers|via the|visible t'
        'o|warranties including|warranties of|way provided|way shall|way that|whatever you|when no|when you|where to|which a|which must|while giving|whoever ge'
        'nerated|whoever is|will not|wishes of|with a|with instructions|with other|with standard|with the|with this|with your|within an|within your|without any'
        '|without limitation|without restriction|without specific|would cause|written permission|you and|you can|you changed|you choose|you do|you duplicate|yo'
        'u if|you insert|you is|you may|you re|you will|your copy|your corporation|your modifications|your own|yours by'
    ),
    'CC0-1.0#text': (
        '0 universal|1 0|1 copyright|11 march|1996 on|2 waiver|3 public|4 a|4 limitations|9 ec|96 9|a below|a commons|a database|a free|a law|a no|a particular'
        '|a party|a person|a royalty|a work|abandoned surrendered|abandons and|absence of|account affirmer|accuracy or|acknowledges that|action in|action to|ac'
        'tion whether|action with|adapt distribute|addition to|additional consideration|advertising or|affected by|affected person|affirmer are|affirmer discla'
        'ims|affirmer hereby|affirmer makes|affirmer offers|affirmer s|affirmer to|affirmer understands|affirms that|against unfair|all an|all of|all territori'
        'es|all to|amended or|an as|an attorney|an original|an owner|and acknowledges|and all|and any|and associated|and causes|and disclaimers|and disclaims|a'
        'nd does|and efforts|and for|and has|and in|and intended|and iv|and makes|and motivations|and of|and or|and privacy|and publicly|and redistribute|and r'
        'elated|and reuse|and scientific|and subsequent|and successors|and surrenders|and the|and to|and translate|and unconditional|and unconditionally|and un'
        'der|and vii|and without|any amended|any associated|any current|any expectation|any form|any kind|any national|any necessary|any number|any of|any othe'
        'r|any part|any person|any purpose|any purposes|any reason|any use|applicable law|applied by|apply cc0|apply to|are not|are waived|arising under|as con'
        'templated|as freely|as future|as is|as of|as possible|as those|as well|assert any|associated claims|associating cc0|at large|attorney client|author s|'
        'authorship and|automatically confer|available under|b affirmer|based on|basis creative|be deemed|be judged|be preserved|be protected|be subject|below '
        'upon|below v|benefit of|build upon|but are|but not|by affirmer|by applicable|by but|by copyright|by the|by this|c affirmer|can reliably|cancellation t'
        'ermination|case affirmer|case contrary|causes of|cc0 1|cc0 may|cc0 on|cc0 or|cc0 to|cc0 was|cc0 with|certain owners|claims and|claims of|clearing righ'
        'ts|client relationship|code cc0|commercial advertising|commercial purposes|commons corporation|commons is|commons legal|commons makes|commons of|commo'
        'ns provides|commons that|commons to|communicate and|compensation the|competition in|concerning the|confer exclusive|consents permissions|consideration'
        ' or|contemplated by|contrary to|contravention of|contribute to|contributing to|copies and|copyright and|corporation is|corresponding rights|council of'
        '|create an|creative commons|creative cultural|creator and|cultural and|culture and|current or|d affirmer|damages resulting|data in|database each|datab'
        'ase rights|databases and|date cc0|deemed effective|defects accuracy|defined below|depicted in|detriment of|directive 96|directive and|disclaimers a|di'
        'sclaims liability|disclaims responsibility|discoverable all|display communicate|disrupt the|dissemination use|distribute perform|distribute the|distri'
        'bution for|distribution of|document and|document b|document does|document or|does not|duration provided|duty or|each a|each affected|each and|each mem'
        'ber|ec of|effect of|effective as|efforts of|either case|elects to|enjoyment of|equitable action|equivalent or|errors whether|european parliament|exclu'
        'sive copyright|exclusive irrevocable|exercise affirmer|exercise any|existing as|expectation of|express implied|express statement|extensions iii|extent'
        ' permissible|extent permitted|extent that|extent the|extraction dissemination|fallback should|fear of|firm and|fitness for|following i|for a|for any|f'
        'or clearing|for damages|for obtaining|for the|for their|for these|form whatsoever|free culture|free non|freely as|from the|fully intending|fully perma'
        'nently|further affirmer|further production|future claims|future medium|future time|gain reputation|grants to|greater distribution|greatest extent|has '
        'no|he or|heirs and|held by|her copyright|her remaining|hereby affirms|hereby grants|hereby overtly|hereunder and|hereunder statement|his or|i exercise'
        '|i in|i the|ideal of|ii assert|ii for|ii moral|iii in|iii publicity|image or|implementation thereof|implementations thereof|implied statutory|in a|in '
        'addition|in all|in any|in contravention|in either|in other|in paragraph|in part|in regards|in such|in the|include but|including any|including existing'
        '|including future|including without|incorporate in|ineffective under|ineffectiveness shall|information on|information or|infringement build|infringeme'
        'nt or|intended legal|intending that|into account|invalid or|invalidate the|invalidity or|irrevocable and|irrevocably and|is an|is and|is basis|is not|'
        'is so|its terms|iv for|iv rights|judged affirmer|judged legally|jurisdictions throughout|kind concerning|knowledge of|known or|large and|latent or|lat'
        'er claims|law affirmer|law c|law firm|law or|law such|law then|laws of|legal code|legal effect|legal or|legal protection|legal services|legally invali'
        'd|liability for|license and|license fallback|license for|license shall|license the|license to|licensed or|likeness depicted|limitation any|limitation '
        'commercial|limitation warranties|limitations and|limitations in|limited to|made available|makes no|makes the|march 1996|maximum duration|maximum exten'
        't|may apply|may be|may contribute|meaning and|medium and|member of|merchantability fitness|modify incorporate|moral rights|most jurisdictions|motivati'
        'ons and|national implementation|national implementations|necessary consents|neighboring rights|no duty|no representations|no trademark|no warranties|n'
        'on exclusive|non infringement|non sublicensable|non transferable|not a|not be|not create|not discoverable|not i|not in|not invalidate|not limited|not '
        'provide|now known|number of|obligation with|obtaining any|of 11|of a|of action|of additional|of affirmer|of an|of any|of applicable|of authorship|of c'
        'c0|of contributing|of copies|of copyright|of creative|of data|of databases|of each|of errors|of his|of infringement|of latent|of later|of most|of othe'
        'r|of others|of purpose|of such|of the|of this|of title|offers the|on an|on applicable|on the|on those|or a|or absence|or any|or compensation|or corres'
        'ponding|or equitable|or future|or greater|or her|or ii|or ineffective|or ineffectiveness|or likeness|or neighboring|or not|or obligation|or other|or o'
        'therwise|or patent|or performer|or promotional|or she|or successor|or the|or to|or treaty|or unknown|or use|or warranties|or works|original author|ori'
        'ginal work|other defects|other legal|other persons|other purposes|other rights|other similar|other works|others for|otherwise affected|otherwise inclu'
        'ding|overtly fully|owner of|owner s|owners may|owners wish|paragraph 4|parliament and|part of|part through|partial invalidity|particular purpose|party'
        ' to|patent rights|perform display|performer s|permanently irrevocably|permanently relinquish|permissible under|permissions or|permitted by|permitted t'
        'aking|person a|person associating|person s|persons that|pertaining to|possible in|present or|preserved to|privacy rights|production of|promote the|pro'
        'motional purposes|protected by|protecting against|protecting the|protection of|provide legal|provided by|provided hereunder|provides this|public as|pu'
        'blic at|public can|public license|publicity and|publicly distribute|purpose 3|purpose 4|purpose in|purpose non|purpose of|purpose the|purpose whatsoev'
        'er|purposes and|purposes including|purposes the|purposes these|quiet enjoyment|reason be|redistribute as|regarding the|regards to|related or|related r'
        'ights|relationship creative|reliably and|relinquish those|remainder of|remaining copyright|representations or|reproduce adapt|reputation or|required f'
        'or|rescission cancellation|respect to|responsibility for|resulting from|retained by|reuse and|reuse of|revocation rescission|right to|rights 1|rights '
        'a|rights and|rights copyright|rights defined|rights held|rights in|rights include|rights of|rights pertaining|rights protecting|rights required|rights'
        ' retained|rights such|rights throughout|rights to|royalty free|s and|s copyright|s each|s express|s heirs|s iii|s image|scientific works|services dist'
        'ribution|shall be|shall not|she is|she will|should any|similar equivalent|so judged|statement of|statutory or|subject to|sublicensable non|subsequent '
        'owner|successor version|successors fully|such as|such case|such directive|such partial|such waiver|surrendered licensed|surrenders all|taking into|ter'
        'mination or|terms with|territories worldwide|that creative|that he|that may|that such|that the|the absence|the affirmer|the benefit|the commons|the co'
        'uncil|the creator|the date|the detriment|the european|the extent|the extraction|the following|the further|the greatest|the ideal|the information|the l'
        'aws|the legal|the license|the limitations|the maximum|the meaning|the original|the person|the present|the public|the purpose|the quiet|the remainder|t'
        'he right|the use|the waiver|the work|the world|their work|then the|thereof 2|thereof including|these and|these owners|this cc0|this document|this info'
        'rmation|those arising|those rights|through the|throughout the|time extensions|title merchantability|to a|to affirmer|to apply|to disrupt|to each|to ex'
        'ercise|to gain|to permanently|to promote|to reproduce|to revocation|to the|to this|trademark or|transferable non|translate a|treaty and|treaty includi'
        'ng|unconditional license|unconditionally waives|under any|under applicable|under cc0|under directive|under its|understands and|unfair competition|univ'
        'ersal creative|unknown including|upon modify|upon the|use and|use of|use thereof|v rights|version of|vi database|vii other|voluntarily elects|waived a'
        'bandoned|waiver affirmer|waiver for|waiver is|waiver shall|waiver to|waives abandons|warranties of|warranties regarding|was applied|well as|whatsoever'
        ' and|whatsoever including|whether now|whether or|will not|wish to|with a|with knowledge|with respect|without any|without fear|without limitation|work '
        'and|work as|work by|work certain|work d|work express|work for|work further|work i|work ii|work in|work iv|work made|work of|work or|work should|work s'
        'ubject|work the|work under|work vi|work voluntarily|works commons|works or|works provided|works reuse|world automatically|world based|worldwide ii'
    ),
    'GFDL-1.3#text': (
        '0 license|0 preamble|1 2008|1 2009|1 3|1 applicability|1 had|1 will|10 future|100 and|100 you|11 relicensing|2 and|2 verbatim|2 were|2000 2001|2001 20'
        '02|2002 2007|2007 2008|2008 copyright|2008 free|2008 the|2009 provided|25 words|3 0|3 3|3 above|3 copying|3 is|3 november|3 or|3 you|30 days|4 above|4'
        ' modifications|4 replacing|4 to|5 combining|5 words|6 collections|60 days|7 aggregation|8 translation|9 termination|a back|a chance|a collection|a com'
        'pilation|a complete|a computer|a copy|a copyleft|a cover|a disagreement|a distinguishing|a document|a draft|a format|a free|a front|a kind|a large|a l'
        'icense|a licensee|a machine|a manual|a massive|a matter|a modified|a named|a network|a not|a notice|a particular|a passage|a portion|a previous|a prin'
        'cipal|a printed|a provisionally|a proxy|a public|a publicly|a secondary|a section|a server|a single|a specific|a standard|a storage|a textbook|a title'
        '|a translation|a transparent|a unique|a use|a variety|a version|a volume|a way|a work|a world|above and|above definition|above for|above provided|abse'
        'nce of|accept compensation|accept the|acceptance of|access to|accessible at|according to|acknowledgements and|acknowledgements dedications|acknowledge'
        'ments or|acting on|actual cover|actual title|add a|add an|add another|add no|add other|add their|add to|added by|added material|added the|addendum bel'
        'ow|addendum how|adding at|addition copying|addition to|addition you|address new|addressed as|adjacent pages|adjacent to|adjustment to|after the|after '
        'your|agents or|aggregate 8|aggregate if|aggregate or|aggregate the|aggregate this|aggregate which|aggregation with|alike 3|all as|all copies|all invar'
        'iant|all of|all other|all sections|all the|all their|all these|all violation|all words|all works|allowed 0|allowed to|along with|already includes|also'
        ' clearly|also follow|also include|also lend|also provides|alternatives to|amount of|an aggregate|an appropriate|an example|an image|an item|an mmc|an '
        'opaque|an organization|an otherwise|an unaltered|an updated|and 2|and 3|and a|and add|and all|and also|and any|and b|and back|and conditions|and conta'
        'in|and contains|and continue|and definitions|and disclaimers|and distribute|and edited|and finally|and follow|and from|and has|and if|and in|and indep'
        'endent|and is|and jpg|and legibly|and license|and likewise|and list|and modification|and multiple|and no|and not|and on|and one|and or|and other|and p'
        'reserve|and publisher|and put|and redistribute|and replace|and required|and satisfy|and standard|and subsequently|and that|and the|and tone|and until|'
        'and useful|and visible|and will|and with|and you|another but|another document|another language|any a|any attempt|any be|any existing|any given|any inv'
        'ariant|any large|any later|any manual|any mathematics|any medium|any member|any modified|any one|any other|any person|any rights|any section|any secti'
        'ons|any set|any substantial|any such|any textual|any time|any title|any version|any warranty|any work|any world|anybody can|anybody to|appear in|appea'
        'r on|appearance of|appendices that|appendix or|applicability and|applicable to|applies to|apply to|appropriate copyright|approved by|are acting|are ce'
        'rtain|are considered|are designated|are listed|are multiple|are needed|are none|are not|are reproduced|are too|arranged to|arrangement made|arrangemen'
        'ts made|as a|as acknowledgements|as are|as authors|as being|as expressly|as fit|as front|as future|as given|as invariant|as long|as many|as part|as re'
        'gards|as secondary|as stated|as such|as the|as they|as verbatim|as well|as you|ascii without|assert or|assure everyone|at any|at least|at most|at the|'
        'at your|attempt otherwise|attribution share|august 1|author and|author or|author s|authoritative definition|authorizes you|authors and|authors if|auth'
        'ors of|authors one|authorship of|automatic translation|automatically terminate|available and|available drawing|available dtd|available to|b list|b per'
        'manently|back cover|based on|be a|be added|be at|be designated|be distinct|be distributed|be entitled|be free|be included|be listed|be placed|be read|'
        'be replaced|be similar|be treated|be used|because free|been approved|been arranged|been published|been terminated|before august|before redistributing|'
        'before the|begin distribution|beginning of|behalf of|being considered|being list|being those|below g|below refers|below such|between the|beyond what|b'
        'ody of|book the|book we|both covers|bracket the|business in|but changing|but different|but endorsements|but may|but not|but only|but this|but you|by a'
        'dding|by an|by any|by arrangement|by creative|by or|by others|by proprietary|by readers|by reference|by sa|by some|by that|by the|by this|by various|b'
        'y you|c 2000|c state|c year|california as|called an|called opaque|can be|can decide|can edit|carry clearly|case of|cc by|cease all|certain secondary|c'
        'ertain short|cessation moreover|chance to|changes limited|changing it|changing the|choice of|choose any|choose that|clearly and|code we|collaboration '
        'or|collaboration site|collection and|collection consisting|collection provided|collections of|combination all|combination of|combination you|combine a'
        'ny|combine the|combined work|combining documents|come with|commercial philosophical|commercially or|commonly have|commons attribution|commons corporat'
        'ion|compensation in|compilation is|compilation of|compilation s|complements the|complete transparent|composed of|computer network|concerns see|conditi'
        'ons can|conditions either|conditions in|conditions of|conditions stated|conditions whatsoever|conflict in|conforming simple|connection with|considered'
        ' a|considered part|considered responsible|considered to|consisting of|contact the|contain no|contain one|contain zero|contained in|containing the|cont'
        'ains a|contains nontrivial|contains nothing|contains xyz|contents make|continue the|contributor acknowledgements|control the|copied from|copied verbat'
        'im|copies 3|copies and|copies if|copies in|copies include|copies of|copies or|copies the|copies to|copies under|copies you|copy a|copy along|copy and|'
        'copy directly|copy distribute|copy if|copy made|copy modify|copy of|copy or|copy represented|copy that|copy will|copying in|copying of|copying with|co'
        'pying you|copyleft license|copyleft versions|copyleft which|copyright and|copyright c|copyright holder|copyright holders|copyright law|copyright notic'
        'e|copyright notices|copyright resulting|copyrightable works|corporation a|corporation with|could be|could fall|cover and|cover are|cover both|cover mu'
        'st|cover previously|cover text|cover texts|covers as|covers if|covers in|covers must|covers of|covers that|create one|creative commons|credit for|cure'
        ' the|d preserve|days after|deals exclusively|decide which|dedications endorsements|dedications given|dedications or|dedications preserve|dedications y'
        'ou|defined in|definition of|definition the|definitions this|delete all|delete any|derivative works|derivatives with|describing the|designate some|desi'
        'gnated as|designed for|designed this|detail to|differ in|different contents|directly or|directly within|disagreement between|disclaimer the|disclaimer'
        's are|disclaimers if|disclaimers in|disclaimers may|disclaimers next|disclaimers provided|disclaimers the|disclaiming warranties|discourage subsequent'
        '|display copies|distinct from|distinguishing version|distribute a|distribute an|distribute and|distribute however|distribute it|distribute opaque|dist'
        'ribute the|distribute translations|distribute verbatim|distributed under|distributes copies|distribution and|distribution medium|distribution of|do no'
        't|do these|do this|document 11|document 4|document 7|document all|document already|document an|document and|document are|document as|document below|do'
        'cument but|document contains|document create|document do|document does|document e|document except|document for|document free|document from|document if'
        '|document in|document is|document itself|document may|document means|document must|document numbering|document or|document s|document specifies|docume'
        'nt straightforwardly|document that|document then|document these|document thus|document to|document unaltered|document under|document well|document who'
        'se|document with|document within|document you|documentation a|documentation license|documents forming|documents in|documents or|documents released|doc'
        'uments to|documents unmodified|documents with|documents you|does but|does not|download using|draft by|drawing editor|drawings some|dtd and|duration to'
        '|e add|each of|each opaque|each such|each version|edit is|edit those|edited only|edition to|editor and|editors or|effect on|effective freedom|either c'
        'ommercially|either copied|either cover|either include|either is|either of|electronic equivalent|electronic form|eligible for|else a|enclose the|end of'
        '|endorsement of|endorsements 6|endorsements of|endorsements or|endorsements provided|endorsements such|english version|enough number|ensure that|entir'
        'e aggregate|entities responsible|entitled acknowledgements|entitled dedications|entitled endorsements|entitled gnu|entitled history|entitled xyz|entit'
        'y if|entity that|entity you|equally prominent|equivalent are|equivalent of|ethical or|ever published|everyone is|everyone the|example of|example state'
        'ments|examples in|examples of|except as|exchange for|exclusively with|existing section|explain any|explicit permission|explicitly and|expressly provid'
        'ed|extract a|extracted document|f include|facilities for|fails to|fall directly|fewer than|file format|filling the|finally terminates|first ones|first'
        ' published|first time|fit legibly|fit reasonably|fit the|five of|five unless|five words|follow the|follow this|following copyright|following pages|fol'
        'lowing text|following the|for a|for any|for anybody|for authorship|for automatic|for copies|for drawings|for either|for example|for free|for human|for'
        ' images|for input|for manuals|for modifications|for modified|for or|for output|for previous|for profit|for public|for publicity|for relicensing|for re'
        'vising|for the|for their|for transparent|for verbatim|for which|for works|for your|form otherwise|form shown|format is|format latex|format sgml|format'
        ' whose|formats for|formats include|formats suitable|formats that|formats which|formatters a|formatters or|forming one|foundation if|foundation inc|fou'
        'ndation may|foundation with|four years|francisco california|free documentation|free in|free license|free of|free program|free software|freedom to|free'
        'doms that|from a|from any|from such|from that|from the|from their|from this|from those|from time|from which|from you|front cover|front matter|fsf org|'
        'full lists|full title|functional and|further copying|future copyleft|future revisions|future versions|g preserve|general network|general public|genera'
        'lly available|generated html|generic paint|generic text|get credit|give permission|give them|give you|given a|given in|given on|given therein|gives pe'
        'rmission|giving the|gnu free|gnu general|gnu org|granted to|grants a|h include|had no|half of|has access|has been|has fewer|has no|have any|have been|'
        'have designed|have invariant|have is|have printed|have received|have the|have written|here xyz|herein the|historical connection|history in|history lik'
        'ewise|history preserve|history section|history the|history to|hold legibly|holder and|holder explicitly|holder fails|holder is|holder notifies|holder '
        'saying|holders but|how to|however if|however you|html postscript|https fsf|https www|human modification|i preserve|identical invariant|identify any|id'
        'entify you|if a|if all|if any|if it|if known|if the|if there|if used|if you|if your|image format|image formats|images composed|immediately after|impli'
        'cation that|imply endorsement|in a|in addition|in all|in an|in another|in any|in case|in covers|in detail|in duration|in electronic|in exchange|in for'
        'mats|in free|in its|in media|in or|in order|in other|in parallel|in parentheses|in part|in quantity|in san|in section|in spirit|in that|in the|in thei'
        'r|in this|in title|in whole|inc https|include a|include an|include immediately|include in|include plain|include png|include proprietary|include the|in'
        'clude translations|include warranty|included by|included in|includes a|includes new|incorporate means|incorporated in|incorporated prior|independent d'
        'ocuments|independent works|individual copies|individual works|individually under|input format|input to|insert a|instruction or|into another|into the|i'
        'nvariant section|invariant sections|invariant the|invariant to|is a|is addressed|is an|is applicable|is available|is called|is considered|is eligible|'
        'is entitled|is given|is granted|is in|is included|is instruction|is less|is licensed|is no|is not|is permitted|is precisely|is published|is reinstated'
        '|is released|is requested|is suitable|is the|is to|is void|it 10|it an|it can|it complements|it contains|it either|it for|it has|it in|it individually'
        '|it is|it refers|it remains|it was|it with|it you|item describing|item stating|its derivatives|its license|its principal|its title|itself or|itself pl'
        'us|j preserve|jpg opaque|just after|k for|kind of|known or|l preserve|language a|language here|large enough|large number|last time|later version|latex'
        ' input|latter option|law a|least five|least four|least one|least the|legal commercial|legal rights|legibly all|legibly identify|legibly the|legibly yo'
        'u|lend copies|less than|license 2|license a|license and|license any|license applies|license but|license can|license designed|license document|license '
        'does|license for|license from|license give|license however|license i|license if|license in|license into|license is|license notice|license notices|lice'
        'nse or|license preserves|license principally|license provided|license published|license requires|license somewhere|license such|license the|license th'
        'en|license to|license under|license unlimited|license version|license which|license with|license you|licensed under|licensee and|licenses each|license'
        's of|licensing distribution|likewise combine|likewise the|limit the|limited to|line with|list and|list if|list of|list on|list their|list them|listed '
        'as|listed in|lists of|location for|location from|location if|location until|locations given|long as|m delete|machine generated|machine readable|made b'
        'y|made in|make a|make or|make the|manual or|manual textbook|manuals for|manuals it|manuals providing|many as|markup has|markup or|markup texinfo|massi'
        've multiauthor|material copied|material does|material if|material on|material this|mathematics a|mathematics the|matter of|matter or|matter section|ma'
        'tter sections|matters and|matters or|may accept|may add|may also|may at|may be|may choose|may combine|may contain|may copy|may differ|may distribute|m'
        'ay extract|may have|may include|may make|may not|may omit|may publicly|may publish|may replace|may republish|may use|meaning of|means a|means any|mean'
        's for|means prior|means that|means the|means this|means to|measures to|media that|medium either|medium is|medium that|member of|mentioned below|merge '
        'those|mmc 1|mmc and|mmc contained|mmc is|mmc site|modification by|modification examples|modification of|modification so|modifications adjacent|modific'
        'ations and|modifications in|modifications made|modifications you|modified version|modified versions|modify or|modify sublicense|modify the|modify this'
        '|modifying it|more persons|more than|moreover your|most 25|most 5|most prominent|multiauthor collaboration|multiple identical|multiple invariant|must '
        'also|must appear|must be|must combine|must delete|must do|must either|must enclose|must present|must take|must themselves|n do|name but|name mentioned'
        '|name of|name permission|named appendix|named subunit|names for|near the|need only|needed to|needs free|network location|network locations|network pro'
        'tocols|network using|new authors|new front|new problems|new revised|new versions|next to|no back|no cover|no effect|no front|no invariant|no material|'
        'no other|no section|noncommercially provided|noncommercially secondarily|none the|nontrivial examples|not add|not allowed|not apply|not as|not be|not '
        'being|not by|not considered|not copy|not explain|not fit|not for|not generally|not give|not have|not identify|not limited|not permanently|not required'
        '|not retitle|not specify|not terminate|not themselves|not transparent|not use|not used|nothing but|nothing that|notice and|notice for|notice giving|no'
        'tice grants|notice h|notice of|notice or|notice placed|notice requires|notice saying|notice termination|notice that|notice the|notice these|notice whi'
        'ch|notices a|notices and|notices f|notices in|notices just|notices of|notifies you|notify you|november 1|november 2008|number if|number make|number of'
        '|numbered version|numbering more|numbers or|o preserve|obstruct or|of a|of acceptance|of added|of all|of an|of another|of any|of back|of business|of c'
        'opies|of copyleft|of copyrightable|of cover|of covers|of documents|of each|of following|of formats|of free|of freedom|of front|of historical|of invari'
        'ant|of it|of its|of legal|of markup|of mathematics|of modification|of opaque|of parties|of peer|of pixels|of previous|of program|of secondary|of secti'
        'on|of sections|of some|of subject|of such|of suitable|of text|of that|of the|of these|of this|of those|of transparent|of up|of violation|of you|of you'
        'r|old one|omit a|on a|on behalf|on covers|on explicit|on its|on printed|on the|on these|one copy|one entity|one half|one of|one on|one or|one passage|'
        'one section|one stating|one the|one year|ones listed|only as|only by|only contain|only one|only the|onto adjacent|opaque copies|opaque copy|opaque exa'
        'mples|opaque formats|operator of|option designate|option of|option you|or a|or absence|or all|or any|or appendices|or authors|or back|or by|or concern'
        's|or contains|or control|or copies|or dedications|or disclaimer|or discourage|or distribute|or distribution|or else|or entities|or entity|or for|or fu'
        'rther|or history|or if|or imply|or in|or invariant|or its|or mmc|or modify|or more|or noncommercially|or of|or on|or other|or pdf|or political|or proc'
        'essing|or publisher|or reference|or republish|or retailers|or rights|or some|or state|or that|or the|or through|or to|or translated|or whether|or with'
        '|or without|or work|or works|or xml|order to|org everyone|org licenses|organization as|organization incorporate|original author|original documents|ori'
        'ginal english|original publisher|original version|original versions|other combination|other conditions|other copyright|other documents|other functiona'
        'l|other implication|other material|other respects|other section|other separate|other than|other work|other works|others this|otherwise they|otherwise '
        'to|otherwise transparent|output purposes|overall subject|page and|page as|page copyright|page for|page if|page itself|page means|page the|page then|pa'
        'ges as|pages if|paint programs|parallel under|parentheses following|parentheses the|part a|part as|part into|part of|particular copyright|particular n'
        'umbered|parties for|parties who|passage of|passages of|pdf designed|pdf produced|peer review|permanently authorizes|permanently if|permanently reinsta'
        'ted|permission b|permission from|permission is|permission k|permission to|permission under|permit their|permit when|permitted to|person or|persons or|'
        'philosophical ethical|pixels generic|place of|placed by|placed in|placed on|plain ascii|plus such|png xcf|political position|portion of|position regar'
        'ding|possesses a|postscript or|preamble the|preceding the|precisely this|precisely xyz|present the|present version|preserve all|preserve any|preserve '
        'in|preserve its|preserve the|preserves for|prevail if|previous publisher|previous sentence|previous version|previous versions|previously added|princip'
        'al authors|principal place|principally for|printed book|printed copies|printed covers|prior to|problems or|processing tools|processors for|processors '
        'sgml|produced by|profit corporation|program code|program should|programs or|prominent and|prominent appearance|prominent facilities|proprietary format'
        's|proprietary word|protocols a|provide you|provided it|provided that|provided the|provided under|provided you|provides prominent|providing the|provisi'
        'onally unless|proxy can|proxy s|prudent steps|public a|public access|public has|public is|public it|public license|public permission|public standard|p'
        'ublic statement|public that|public wiki|publicity for|publicly available|publicly display|publish new|publish or|publish printed|published as|publishe'
        'd at|published by|published not|published on|published under|publisher a|publisher d|publisher means|publisher of|publisher s|publisher that|publisher'
        's or|publishes copyrightable|purpose is|purpose of|purposes only|put the|qualify as|quantity if|quantity to|read and|readable copy|readable transparen'
        't|readers is|reading or|reasonable means|reasonably on|reasonably prudent|receipt of|received copies|received notice|recommend releasing|recommend thi'
        's|redistribute it|redistributing any|reference 1|reference in|refers to|regarding them|regarding verbatim|regardless of|regards disclaiming|reinstated'
        ' a|reinstated permanently|reinstated receipt|related matters|relationship could|relationship of|release the|release you|released under|releasing these'
        '|relicensing addendum|relicensing if|relicensing massive|remain thus|remains a|replace the|replaced with|replacing invariant|represented in|reproduced'
        ' in|republish a|republish an|requested but|require changing|required cover|required texts|required that|requirement c|requirement of|requirement secti'
        'on|requires cover|requires special|requires to|requiring permission|respects if|respects regarding|respects you|responsible for|rest onto|resulting fr'
        'om|retailers of|retitle any|review or|revised versions|revising the|revisions of|rights from|rights have|rights of|rights to|rights under|role of|roya'
        'lty free|rules of|s and|s cover|s license|s of|s overall|s public|s title|s users|sa means|sa on|same adjustment|same conditions|same cover|same entit'
        'y|same freedoms|same material|same name|same organization|same sense|same site|same title|san francisco|satisfy these|saying it|saying this|says that|'
        'secondarily this|secondary section|secondary sections|secondary then|section 1|section 3|section 4|section all|section and|section does|section entitl'
        'ed|section if|section in|section is|section may|section name|section numbers|section o|section of|section titles|section to|section unique|section whe'
        'n|section you|sections 2|sections and|sections are|sections as|sections being|sections entitled|sections front|sections if|sections in|sections may|se'
        'ctions no|sections of|sections or|sections then|sections whose|sections with|sections without|sections you|see https|sense it|sense of|sentence j|sepa'
        'rate and|server a|server that|set of|sgml or|share alike|short passages|should come|should if|should put|shown in|similar in|simple html|single copy|s'
        'ingle document|site at|site cc|site may|site means|site or|site under|situation if|so you|software because|software does|software foundation|software '
        'license|software manuals|software needs|software we|some or|some other|some reasonable|some widely|some word|somewhere other|special permission|specif'
        'ic section|specification is|specified version|specifies that|specify a|spirit to|standard conforming|standard network|standard you|stands for|state in'
        '|state on|stated above|stated herein|stated in|stated location|statement of|statements of|states that|stating at|stating the|steps when|storage or|str'
        'aightforwardly with|subject matter|subject or|subject thus|sublicense or|subsequent modification|subsequently incorporated|substance and|substantial a'
        'mount|subunit of|such a|such as|such following|such manual|such new|such section|such title|suit the|suitable for|suitable formats|take reasonably|tec'
        'hnical measures|terminate the|terminate your|terminated and|terminates your|termination of|termination you|terms and|terms defined|terms of|texinfo in'
        'put|text a|text and|text editors|text for|text formatters|text has|text may|text near|text requirement|text that|text the|text to|textbook of|textbook'
        ' or|texts a|texts and|texts are|texts being|texts for|texts front|texts given|texts in|texts line|texts may|texts on|texts or|texts replace|texts you|'
        'textual work|than 100|than five|than one|than this|that a|that added|that anybody|that are|that bracket|that can|that carry|that commonly|that contain'
        's|that copyright|that could|that deals|that derivative|that distributes|that document|that edition|that has|that is|that it|that license|that of|that '
        'overall|that proxy|that publishes|that qualify|that same|that says|that section|that specified|that the|that these|that this|that translates|that vers'
        'ion|that was|that were|that work|that you|the above|the actual|the addendum|the aggregate|the author|the authoritative|the authors|the back|the beginn'
        'ing|the body|the cessation|the collection|the combination|the combined|the compilation|the conditions|the contributor|the copies|the copyright|the cov'
        'er|the covers|the creative|the document|the documents|the dtd|the effective|the electronic|the end|the entire|the equivalent|the extracted|the first|t'
        'he following|the form|the free|the front|the full|the general|the gnu|the history|the individual|the invariant|the last|the latter|the legal|the licen'
        'se|the licenses|the list|the machine|the material|the meaning|the mmc|the modifications|the modified|the most|the name|the network|the notice|the old|'
        'the operator|the option|the original|the other|the present|the previous|the principal|the public|the publisher|the publishers|the purpose|the reading|'
        'the relationship|the required|the requirement|the rest|the role|the rules|the same|the section|the sense|the site|the situation|the software|the state'
        'd|the subject|the substance|the terms|the text|the three|the title|the translation|the various|the version|the violation|the whole|the with|the work|t'
        'heir copyright|their names|their text|their titles|their use|their warranty|their work|them a|them all|them the|themselves be|themselves derivative|th'
        'en add|then if|then it|then there|then your|there are|there is|there were|therein l|these conditions|these copies|these cover|these examples|these inv'
        'ariant|these may|these sections|these things|these titles|these warranty|they must|they preserve|they release|things in|this add|this definition|this '
        'document|this is|this license|this mmc|this requirement|this section|this transparent|this with|those notices|those of|those two|those works|three mer'
        'ge|through arrangements|through your|thus accessible|thus if|thus incorporated|thus licensing|thus published|thwart or|time before|time such|time to|t'
        'ime you|title 9|title and|title as|title distinct|title either|title equally|title of|title page|title preceding|title section|title with|title year|t'
        'itles are|titles in|titles m|titles must|titles section|titles to|titles with|titles you|to 25|to 30|to 60|to a|to address|to any|to appear|to assert|'
        'to assure|to be|to choose|to conflict|to copy|to do|to download|to edit|to ensure|to fit|to five|to get|to give|to gives|to hold|to it|to limit|to mak'
        'e|to notify|to november|to obstruct|to permit|to preserve|to provide|to publish|to related|to software|to suit|to text|to the|to these|to this|to thos'
        'e|to thwart|to time|to use|to whoever|together with|tone of|too voluminous|tools are|translated into|translates xyz|translation and|translation is|tra'
        'nslation of|translation to|translation translation|translations of|translations requires|transparent an|transparent copies|transparent copy|transparen'
        't file|transparent if|transparent image|transparent is|treated as|two alternatives|typically require|unaltered copy|unaltered in|under cc|under copyri'
        'ght|under precisely|under the|under this|under your|unique by|unique number|unless and|unless they|unlimited in|unmodified and|until at|until the|up t'
        'o|updated version|use in|use it|use technical|use that|use the|use their|use this|used for|used that|used to|useful document|users beyond|using a|usin'
        'g public|variety of|various documents|various original|various parties|verbatim copies|verbatim copying|verbatim or|version 1|version 5|version a|vers'
        'ion applies|version as|version but|version by|version ever|version filling|version for|version gives|version if|version includes|version it|version n|'
        'version number|version of|version only|version or|version permanently|version published|version s|version that|version to|version together|version und'
        'er|version will|versions it|versions of|versions provided|versions which|versions will|violation by|violation of|violation prior|visible you|void and|'
        'volume of|voluminous to|warranties any|warranty disclaimers|was based|was published|way requiring|way to|we have|we recommend|web server|well as|well '
        'before|were any|were first|were thus|what the|whatsoever to|when the|when you|whether it|which are|which do|which future|which is|which means|which sh'
        'ould|which states|which the|while not|who have|whoever possesses|whole aggregate|whole or|whose markup|whose purpose|whose specification|whose title|w'
        'hose titles|wide royalty|wide web|widely available|wiki that|will automatically|will be|will prevail|will remain|will typically|with a|with all|with a'
        'n|with any|with at|with changes|with each|with generic|with independent|with manuals|with modifications|with no|with or|with other|with related|with t'
        'exts|with the|with this|with translations|within that|within the|without cover|without markup|without modifying|word processors|words a|words and|word'
        's as|words of|work any|work containing|work from|work in|work need|work regardless|work s|work that|work under|work while|works a|works and|works in|w'
        'orks of|works permit|works that|works thus|works whose|world wide|written include|www gnu|xcf and|xml for|xml using|xyz according|xyz in|xyz means|xyz'
        ' or|xyz stands|year after|year authors|year new|year your|years before|you accept|you add|you also|you any|you are|you as|you begin|you cease|you cont'
        'act|you copy|you cure|you distribute|you follow|you from|you have|you include|you insert|you make|you may|you modify|you must|you of|you or|you preser'
        've|you publish|you release|you should|you to|you under|you use|you with|you you|your agents|your choice|your combined|your document|your documents|you'
        'r license|your modifications|your modified|your name|your option|your receipt|your rights|zero invariant'
    ),
    'GPL-2.0#text': (
        '0 this|02110 1301|1 above|1 and|1 april|1 copyright|1 you|10 if|11 because|12 in|1301 usa|1989 1991|1989 ty|1991 copyright|1991 free|2 above|2 in|2 ju'
        'ne|2 of|2 offer|2 you|3 you|4 you|5 you|51 franklin|6 each|69 copyright|7 if|8 if|9 the|a accompany|a brief|a charge|a complete|a consequence|a copy|a'
        ' copyright|a court|a designated|a distinguishing|a failure|a fee|a free|a license|a licensee|a medium|a new|a notice|a particular|a patent|a pointer|a'
        ' portion|a program|a programmer|a sample|a short|a special|a storage|a subroutine|a version|a volume|a warranty|a whole|a work|a written|a you|above b'
        'e|above on|above provided|above the|absence of|absolutely no|accept this|acceptance of|access to|accompanies the|accompany it|accord with|achieve this'
        '|act of|actions are|activities other|add an|add information|addition mere|address new|addressed as|advised of|aggregation of|agreed to|agreement or|al'
        'l copyright|all derivatives|all for|all its|all modules|all necessary|all of|all the|all third|all those|allegation of|allowed only|allowed preamble|a'
        'long with|also add|also do|also for|also get|also meet|alter the|alternative is|among countries|an announcement|an appropriate|an executable|an explic'
        'it|an interactive|an offer|and 2|and a|and all|and any|and appropriately|and can|and change|and charge|and conditions|and copy|and disclaimer|and dist'
        'ribute|and each|and every|and fitness|and give|and installation|and its|and modification|and of|and only|and or|and ours|and paper|and passed|and perf'
        'ormance|and reuse|and separate|and show|and so|and telling|and that|and the|and this|and thus|and to|and will|and you|announcement including|announcem'
        'ent these|announcement your|another language|another work|any associated|any attempt|any change|any copyright|any derivative|any free|any further|any '
        'general|any kind|any later|any medium|any other|any part|any particular|any patent|any patents|any portion|any problems|any program|any such|any third'
        '|any to|any version|any warranty|any work|anyone to|anything that|applicable law|application of|applications with|applies to|apply and|apply in|apply '
        'it|apply these|apply to|appropriate copyright|appropriate parts|appropriately publish|april 1989|are designed|are different|are imposed|are not|are ou'
        'tside|are prohibited|are referring|are welcome|arising out|as a|as distribution|as expressly|as if|as is|as part|as permitted|as published|as separate'
        '|as such|as to|as you|ask for|ask you|associated interface|assume the|at all|at compilers|at least|at no|at your|attach the|attach them|attempt otherw'
        'ise|author donor|author gnomovision|author s|author this|author to|authors commit|authors reputations|automatically receives|automatically terminate|a'
        'void the|away your|b above|b accompany|b you|balance of|based on|be a|be called|be distributed|be guided|be liable|be licensed|be mouse|be of|be on|be'
        ' reasonably|be similar|be to|be useful|because the|been advised|been made|being rendered|believed to|below refers|best way|binary form|body of|boston '
        'ma|both it|brief idea|bring the|but changing|but does|but may|but not|but when|but without|by all|by applicable|by contrast|by copyrighted|by court|by'
        ' electronic|by james|by law|by modifying|by offering|by others|by patents|by public|by running|by software|by someone|by the|by third|by this|by you|c'
        ' 1989|c accompany|c for|c if|c should|c they|c year|called something|can apply|can be|can change|can do|can get|can redistribute|cannot distribute|can'
        'not impose|carry prominent|case this|cause any|cause it|cause the|certain conditions|certain countries|certain responsibilities|certain that|change b|'
        'change free|change it|change the|change under|changed the|changing it|charge a|charge for|charge no|charge there|charge to|choice this|choose any|circ'
        'umstance the|circumstances it|claim rights|claims or|claims this|clear that|clear what|clicks or|code 4|code and|code as|code distributed|code even|co'
        'de for|code from|code is|code means|code or|code this|code to|code which|collective works|comes with|commands interactively|commands show|commands you'
        '|commit to|compelled to|compilation and|compiler kernel|compilers written|complete corresponding|complete machine|complete source|compliance 5|complia'
        'nce by|component itself|components compiler|concerns each|conditions a|conditions and|conditions are|conditions either|conditions for|conditions how|c'
        'onditions of|conditions type|conditions you|consequence of|consequence you|consequential damages|consider it|considered independent|consistent applica'
        'tion|conspicuously and|constantly by|constitute a|contact you|containing the|contains a|contains or|contains plus|contents constitute|contest validity'
        '|contest your|contradict the|contrast the|contributions to|control compilation|control the|convey the|coon 1|coon president|copies directly|copies of|'
        'copies or|copy an|copy and|copy distribute|copy from|copy modify|copy of|copy or|copy the|copying distributing|copying distribution|copyright c|copyri'
        'ght disclaimer|copyright holder|copyright holders|copyright interest|copyright law|copyright line|copyright notice|copyright the|copyrighted by|copyri'
        'ghted interfaces|correction 12|corresponding machine|corresponding source|cost of|could even|could satisfy|countries either|countries not|countries so'
        '|counts as|course the|court judgment|court order|covered by|covered only|customarily used|damages arising|damages end|damages including|danger that|da'
        'ta being|data or|date of|decide if|decision will|defective you|definition files|deny you|depends on|derivative or|derivative work|derivative works|der'
        'ivatives of|derived from|designated place|designed to|detail to|details the|details type|details you|develop a|differ in|different write|directly or|d'
        'isclaimer for|disclaimer of|disclaims all|display an|distinguishing version|distribute and|distribute copies|distribute corresponding|distribute or|di'
        'stribute so|distribute software|distribute such|distribute the|distribute them|distribute verbatim|distributed in|distributed need|distributed through'
        '|distributed under|distributing or|distributing the|distribution a|distribution and|distribution conditions|distribution is|distribution limitation|di'
        'stribution medium|distribution of|distribution system|do not|do one|do so|do these|do use|document but|does 1|does copyright|does not|donor to|each an'
        'd|each author|each copy|each file|each licensee|each source|each time|each version|effect making|effectively convey|either by|either expressed|either '
        'of|either source|either the|either verbatim|either version|electronic and|else and|else grants|else saying|employer if|end of|enforcing compliance|ent'
        'ire risk|entire whole|entirely by|entirely from|equivalent access|even be|even if|even the|even though|event unless|ever published|every part|everyone'
        ' can|everyone is|everyone s|everyone understands|example if|except as|except when|exception if|exception the|exceptions for|exchange for|excluded in|e'
        'xcluding those|exclusion of|excuse you|executable form|executable however|executable if|executable or|executable runs|executable work|exercise of|exer'
        'cise the|explicit geographical|expressed or|expressly provided|extend to|extent permitted|failure of|fee 2|fee for|fee you|fifth floor|file should|fil'
        'e to|files and|files plus|files to|finally any|fitness for|floor boston|follow gnu|following a|following notices|following the|for a|for all|for an|fo'
        'r any|for at|for copying|for damages|for details|for each|for enforcing|for everyone|for example|for making|for more|for most|for noncommercial|for ot'
        'her|for permission|for software|for such|for the|for this|for you|forbid anyone|form of|form under|form with|forming a|found one|foundation 10|foundat'
        'ion either|foundation if|foundation inc|foundation may|foundation s|foundation software|foundation we|foundation write|franklin street|free for|free o'
        'f|free program|free programs|free redistribution|free software|free status|free use|freedom not|freedom to|from a|from distribution|from the|from time'
        '|from you|full compliance|full notice|further restrictions|general public|general special|generally no|generous contributions|geographical distributio'
        'n|get it|get the|get your|give any|give the|given a|gives you|gnomovision comes|gnomovision version|gnomovision which|gnu general|gnu lesser|goals of|'
        'granted herein|grants you|gratis or|greatest possible|guarantee your|guided by|hacker signature|has been|has the|have at|have is|have made|have not|ha'
        've received|have the|have their|have you|having been|he or|held invalid|here is|hereby disclaims|herein you|hereinafter translation|holder or|holder s'
        'aying|holder who|holders and|hope that|how to|however as|however nothing|however parties|hypothetical commands|idea of|identifiable sections|if a|if a'
        'ny|if as|if distribution|if he|if identifiable|if its|if necessary|if not|if such|if the|if this|if written|if you|if your|implemented by|implied incl'
        'uding|implied warranties|implied warranty|impose any|impose that|imposed on|in accord|in addition|in an|in any|in certain|in detail|in effect|in eithe'
        'r|in exchange|in full|in new|in no|in object|in or|in other|in part|in reliance|in spirit|in such|in the|in themselves|in whole|in writing|inability t'
        'o|inaccurate or|inc 51|inc hereby|incidental or|include anything|included without|including an|including any|including but|incorporate parts|incorpora'
        'tes the|incorporating your|independent and|independent of|indicate your|indirectly through|individually obtain|induce you|information on|information y'
        'ou|infringe any|infringement or|installation of|instead of|instead you|intact all|integrity of|intended to|intent is|intent of|interactive but|interac'
        'tive make|interactive mode|interactive use|interactively when|interchange or|interest in|interface definition|interfaces the|into another|into other|i'
        'nto proprietary|introduced by|invalid or|is a|is addressed|is allowed|is believed|is copyrighted|is covered|is derived|is distributed|is found|is free'
        '|is given|is held|is implemented|is included|is intended|is interactive|is licensed|is made|is modified|is no|is normally|is not|is permitted|is restr'
        'icted|is safest|is threatened|is to|is true|is up|is void|is what|is willing|is with|is without|issues conditions|it 6|it and|it by|it clear|it contai'
        'ns|it does|it either|it for|it free|it however|it if|it in|it is|it may|it more|it output|it some|it starts|it that|it thus|it to|it under|it when|it '
        'will|it with|items whatever|its contents|its derivative|its recipients|its scope|its terms|its users|itself accompanies|itself is|james hacker|judgmen'
        't or|june 1991|keep intact|kernel and|kind either|know that|know their|know you|language hereinafter|later version|law except|law if|law or|law that|l'
        'east the|least three|legal permission|lesser general|liable to|library if|library you|license 3|license 7|license 8|license 9|license along|license an'
        'd|license any|license applies|license as|license c|license document|license does|license exception|license for|license from|license however|license if'
        '|license incorporates|license instead|license is|license may|license of|license or|license practices|license since|license terms|license the|license t'
        'herefore|license they|license to|license version|license which|license whose|license will|license would|license you|licensed as|licensed at|licensed f'
        'or|licensed free|licensee cannot|licensee is|licensees extend|licenses are|licenses for|licenses in|licenses terminated|licensor to|like this|limitati'
        'on as|limitation excluding|limitation in|limited to|line and|line to|linking proprietary|long as|loss of|losses sustained|ma 02110|machine readable|ma'
        'de by|made generous|made it|mail if|major components|make certain|make exceptions|make it|make restrictions|make sure|make thoroughly|makes passes|mak'
        'ing modifications|making the|many people|may add|may at|may be|may charge|may choose|may consider|may copy|may differ|may modify|may not|may publish|m'
        'ay redistribute|means all|means either|means the|medium customarily|medium does|medium provided|meet all|menu items|merchantability and|merchantabilit'
        'y or|mere aggregation|mode gnomovision|modification 0|modification are|modification each|modification follow|modifications and|modifications or|modifi'
        'cations to|modified by|modified files|modified program|modified work|modify and|modify it|modify or|modify sublicense|modify the|modify your|modifying'
        ' or|modifying the|modules it|more details|more than|more useful|most effectively|most of|most ordinary|most software|mouse clicks|must be|must cause|m'
        'ust give|must make|must show|name and|name of|names yoyodyne|necessary here|necessary servicing|need not|need to|new free|new problems|new program|new'
        ' programs|new versions|no charge|no event|no more|no warranty|noncommercial distribution|normally distributed|normally print|normally reads|not accept'
        '|not allowed|not apply|not based|not bring|not compelled|not copy|not covered|not derived|not distribute|not excuse|not have|not impose|not include|no'
        't licensed|not limited|not normally|not permit|not price|not reflect|not required|not responsible|not restricted|not signed|not specify|not the|not th'
        'us|not write|nothing else|notice and|notice is|notice like|notice placed|notice that|notices stating|notices that|notices to|number if|number of|objec'
        't code|obligations then|obligations under|obtain patent|of a|of all|of another|of any|of author|of charge|of course|of data|of derivative|of each|of e'
        'xecutable|of following|of free|of having|of it|of merchantability|of our|of patent|of physically|of preserving|of promoting|of protecting|of running|o'
        'f section|of sections|of software|of such|of terms|of that|of the|of these|of this|of transferring|of ty|of vice|of warranty|of what|of who|offer in|o'
        'ffer to|offer valid|offer warranty|offer you|offering access|offering equivalent|on a|on consistent|on each|on how|on it|on of|on the|on we|on what|on'
        ' which|on you|one line|one of|only for|only if|only in|only way|operate with|operating system|option any|option of|option offer|or a|or agreed|or alle'
        'gation|or among|or any|or at|or b|or binary|or by|or c|or can|or collective|or concerns|or consequential|or contest|or copies|or correction|or data|or'
        ' display|or distribute|or distributing|or distribution|or else|or executable|or fitness|or for|or if|or implied|or in|or inability|or indirectly|or is'
        '|or its|or losses|or menu|or modify|or modifying|or new|or not|or object|or of|or other|or otherwise|or publish|or redistribute|or rights|or she|or th'
        'ird|or to|or translated|or unenforceable|or use|or with|or work|or works|or your|order agreement|ordinary way|original authors|original copyright|orig'
        'inal licensor|original so|other circumstances|other free|other licensees|other parties|other party|other pertinent|other program|other programs|other '
        'property|other reason|other recipients|other system|other than|other work|others will|otherwise stated|otherwise that|otherwise to|our decision|our fr'
        'ee|our general|ours we|out of|output a|output from|outside its|paper mail|part contains|part of|part regardless|part thereof|particular circumstance|p'
        'articular purpose|parties are|parties or|parties provide|parties remain|parties to|parties under|parties who|parts of|party for|party has|party who|pa'
        'ssed on|passes at|patent infringement|patent issues|patent license|patent licenses|patent must|patents or|patents we|people have|performance of|perfor'
        'ming source|permission for|permission to|permissions for|permit incorporating|permit linking|permit royalty|permitted above|permitted by|permitted onl'
        'y|permitted to|pertinent obligations|physical act|physically performing|pieces of|place counts|place then|placed by|places the|plus any|plus the|point'
        'er to|portion of|possibility of|possible use|practices many|preamble the|precise terms|preferred form|present version|preserving the|president of|prev'
        'ent this|price our|print an|print or|print such|problems introduced|problems or|program a|program and|program as|program at|program below|program by|p'
        'rogram does|program except|program gnomovision|program if|program in|program including|program independent|program into|program is|program it|program '
        'itself|program means|program normally|program on|program or|program proprietary|program prove|program s|program specifies|program subject|program the|'
        'program to|program under|program whether|program whose|program will|program with|program you|programmer or|programs and|programs even|programs if|prog'
        'rams too|programs whose|prohibited by|prominent notices|promoting the|property right|proprietary applications|proprietary programs|proprietary to|prot'
        'ect your|protecting the|protection and|protection in|prove defective|provide a|provide the|provided that|provided under|public license|public licenses'
        '|public the|publish on|publish revised|publish that|published by|purpose of|purpose see|purpose the|quality and|range of|rather the|readable copy|read'
        'able source|reads commands|reason not|reasonably considered|receive copies|receive it|receive or|receive source|received a|received as|received copies'
        '|received the|receives a|recipient automatically|recipients all|recipients exercise|recipients of|recipients to|redistribute and|redistribute it|redis'
        'tribute the|redistribution of|redistributors of|refer to|referring to|refers to|reflect on|refrain entirely|regardless of|reliance on|remain in|render'
        'ed inaccurate|repair or|reputations finally|required by|required to|requirements apply|responsibilities for|responsible for|rest of|restricted and|res'
        'tricted in|restrictions on|restrictions that|restrictions translate|reuse of|revised and|right claims|right to|rights from|rights granted|rights or|ri'
        'ghts that|rights these|rights to|rights under|rights we|rights with|risk as|royalty free|run you|running for|running the|runs unless|s free|s name|s p'
        'rotection|s software|s source|safest to|same place|same sections|sample alter|satisfy both|satisfy simultaneously|say a|saying it|saying that|school i'
        'f|scope of|scope the|scripts used|section 1|section 2|section as|section has|section is|section to|sections 1|sections as|sections of|sections when|se'
        'e the|separate works|service if|servicing repair|share and|sharing and|she is|short notice|should also|should have|should show|should the|show c|show '
        'the|show them|show w|sign a|signature of|signed it|similar in|simultaneously your|since you|so and|so as|so attach|so long|so on|so that|so they|softw'
        'are also|software and|software are|software distributed|software distribution|software foundation|software generally|software if|software interchange|'
        'software is|software or|software patents|software through|software to|software we|software which|software you|sole purpose|some other|someone else|som'
        'ething other|sometimes make|source along|source code|source distribution|source file|source or|speak of|special exception|special incidental|specifies'
        ' a|specify a|spirit to|start of|started running|starts in|stated in|stating that|status of|steps 1|storage or|street fifth|subject to|sublicense or|su'
        'broutine library|subsection b|such a|such an|such case|such claims|such damages|such holder|such interactive|such modifications|such new|such parties|'
        'such program|suits your|sure that|sure the|surrender the|sustained by|system and|system in|system it|system on|system which|take away|telling the|term'
        ' modification|terminate your|terminated so|terms and|terms do|terms of|terms so|terms to|than copying|than show|than your|that any|that choice|that co'
        'mponent|that contradict|that distribution|that everyone|that forbid|that in|that is|that it|that redistributors|that refer|that system|that there|that'
        ' they|that users|that version|that what|that work|that you|the absence|the act|the appropriate|the author|the balance|the best|the body|the commands|t'
        'he complete|the conditions|the copyright|the corresponding|the cost|the danger|the date|the distribution|the entire|the exclusion|the executable|the e'
        'xtent|the files|the following|the free|the freedom|the full|the general|the gnu|the greatest|the hope|the hypothetical|the implied|the information|the'
        ' integrity|the intent|the library|the license|the licenses|the limitation|the major|the modified|the most|the names|the notices|the object|the offer|t'
        'he only|the operating|the option|the original|the other|the output|the physical|the possibility|the precise|the preferred|the present|the program|the '
        'public|the purpose|the quality|the recipient|the recipients|the rest|the right|the rights|the same|the scope|the scripts|the section|the sharing|the s'
        'oftware|the sole|the source|the start|the term|the terms|the two|the use|the user|the whole|the wide|the work|their licenses|their rights|them as|them'
        ' these|them to|themselves then|then as|then offering|then the|then this|there is|therefore by|thereof to|these actions|these conditions|these requirem'
        'ents|these restrictions|these rights|these terms|these things|they are|they could|they do|they have|they know|they too|things to|third parties|third p'
        'arty|this alternative|this free|this general|this is|this license|this our|this program|this section|this service|this we|this when|thoroughly clear|t'
        'hose countries|those sections|those who|though third|threatened constantly|three years|through any|through that|through you|thus excluded|thus forming'
        '|thus it|thus to|time such|time to|time you|to accept|to achieve|to address|to all|to any|to apply|to ask|to attach|to avoid|to be|to carry|to certain'
        '|to claim|to contact|to contest|to control|to copy|to decide|to deny|to distribute|to do|to each|to exercise|to freedom|to give|to guarantee|to in|to '
        'incorporate|to induce|to infringe|to it|to know|to loss|to make|to modify|to most|to operate|to patent|to permit|to prevent|to print|to protect|to red'
        'istribute|to refrain|to satisfy|to say|to share|to sign|to surrender|to take|to the|to these|to this|to those|to time|to use|to using|to view|to where'
        '|to work|to you|to your|too receive|too when|transferring a|translate to|translated into|translation is|true depends|two goals|two steps|ty coon|type '
        'show|under any|under certain|under copyright|under section|under the|under these|under this|understands that|unenforceable under|unless required|unles'
        's that|up to|usa also|usa everyone|use in|use may|use of|use or|use pieces|use the|use to|used for|used to|useful but|useful to|user how|users may|use'
        'rs this|using it|valid for|validity of|verbatim copies|verbatim or|version 2|version 69|version but|version ever|version is|version number|version or|'
        'version published|version this|version you|versions of|versions will|vice this|view a|void and|volume of|w and|w this|want it|want its|want to|warrant'
        'ies of|warranty 11|warranty and|warranty for|warranty keep|warranty of|warranty or|warranty protection|warranty without|way to|way you|we are|we have|'
        'we need|we protect|we sometimes|we speak|we want|we wish|welcome to|what is|what it|what the|what they|what you|whatever suits|when it|when otherwise|'
        'when run|when started|when we|when you|where the|whether by|whether gratis|whether that|which applies|which contains|which everyone|which gives|which '
        'is|which makes|which must|which the|who have|who may|who places|who receive|who wrote|whole and|whole at|whole if|whole is|whole must|whole or|whole w'
        'hich|whose authors|whose distribution|whose permissions|wide range|will any|will automatically|will be|will individually|will not|willing to|wish that'
        '|wish to|with a|with absolutely|with any|with modifications|with subsection|with such|with the|with this|with two|with you|without any|without even|wi'
        'thout limitation|without warranty|work and|work are|work as|work based|work complete|work containing|work for|work means|work not|work that|work under'
        '|work which|work written|works based|works but|works in|works these|would be|would not|write to|writing the|writing will|written by|written entirely|w'
        'ritten in|written offer|wrote it|year name|years to|you activities|you also|you are|you assume|you by|you can|you cannot|you changed|you conspicuously'
        '|you could|you develop|you distribute|you do|you for|you from|you have|you if|you indicate|you know|you legal|you may|you modify|you must|you or|you p'
        'ermission|you provide|you rather|you receive|you received|you redistribute|you should|you then|you these|you this|you to|you under|you use|you want|yo'
        'u whether|you wish|you work|your acceptance|your copy|your cost|your employer|your freedom|your new|your obligations|your option|your program|your pro'
        'grams|your rights|your school|your work|yoyodyne inc'
    ),
    'GPL-3.0#text': (
        '0 definitions|1 a|1 assert|1 cause|1 displays|1 source|10 9|10 automatic|10 if|10 makes|11 however|11 of|11 patents|12 no|13 concerning|13 use|14 revi'
        'sed|15 and|15 disclaimer|16 if|16 limitation|16 of|17 interpretation|1996 or|2 access|2 anything|2 arrange|2 basic|2 offer|2 tells|20 december|2007 co'
        'pyright|2007 free|2007 nothing|28 march|29 june|3 29|3 arrange|3 of|3 protecting|30 days|4 and|4 conveying|4 provided|4 to|5 conveying|5 provided|6 co'
        'nveying|60 days|6b d|6d a|7 additional|7 apply|7 this|8 termination|9 acceptance|a brief|a certain|a charge|a compilation|a compiler|a computer|a cons'
        'equence|a consumer|a contributor|a convenient|a convey|a copy|a copyright|a country|a covered|a cross|a designated|a different|a disclaiming|a discrim'
        'inatory|a distinguishing|a durable|a dwelling|a failure|a fashion|a fee|a fixed|a format|a free|a further|a gui|a in|a is|a larger|a later|a lawsuit|a'
        ' license|a list|a major|a manner|a means|a menu|a modified|a network|a new|a non|a notice|a particular|a party|a patent|a physical|a pointer|a price|a'
        ' private|a product|a program|a programmer|a prominent|a provisionally|a proxy|a publicly|a recognized|a relevant|a requirement|a result|a right|a roya'
        'lty|a separable|a separately|a short|a single|a specific|a standard|a statement|a storage|a subroutine|a system|a term|a the|a third|a transaction|a t'
        'ypical|a user|a version|a volume|a warranty|a whole|a work|a written|ability to|about box|above be|above cannot|above requirements|absence of|absolute'
        ' waiver|absolutely no|abuse occurs|accept this|acceptance however|acceptance not|acceptance of|access from|access or|access to|accessible means|accomp'
        'anied by|accompanies a|accord with|according to|achieve this|acknowledges your|acquired or|acquired that|across the|actions infringe|activities as|act'
        'ivities but|activities however|activity of|actual knowledge|actually uses|adapt all|add information|add terms|add to|added by|added in|added under|add'
        'itional obligations|additional or|additional permissions|additional terms|address new|addressed as|adopted on|adversely affects|advised of|affects the'
        '|affero general|affirmed under|affirms your|after the|after your|against the|aggregate 6|aggregate does|aggregate if|agree to|agreed to|agreement or|a'
        'im of|all assets|all civil|all for|all its|all material|all necessary|all notices|all of|all or|all other|all patent|all recipients|all rights|all the'
        '|all versions|all violation|alleging that|allow patents|allowed only|allowed preamble|allowed section|along with|already acquired|also add|also convey'
        '|also get|also means|also meet|also receives|also to|alternative is|although the|among developers|an about|an absolute|an aggregate|an agreement|an ap'
        'propriate|an arrangement|an effective|an entity|an exact|an executable|an express|an implementation|an interactive|an interface|an object|an offer|an '
        'official|an organization|ancillary propagation|and 16|and 2|and 5|and a|and adversely|and all|and any|and appropriately|and are|and authors|and b|and '
        'change|and charge|and conditions|and control|and corresponding|and distribute|and dynamically|and each|and execute|and finally|and fitness|and follow|'
        'and for|and give|and giving|and grant|and how|and in|and independent|and installation|and its|and limitation|and modification|and must|and noncommerci'
        'ally|and not|and offer|and only|and or|and other|and otherwise|and paper|and performance|and prominently|and propagate|and protocols|and recipients|an'
        'd show|and so|and that|and the|and this|and to|and under|and until|and use|and valid|and which|and will|and with|and works|and you|anti circumvention|'
        'any additional|any applicable|any attempt|any author|any conditions|any copies|any copyright|any copyrightable|any covered|any express|any further|any'
        ' general|any implied|any intention|any kind|any later|any legal|any liability|any medium|any methods|any non|any of|any on|any other|any part|any pate'
        'nt|any portion|any price|any tangible|any third|any to|any version|any warranty|any work|anyone to|anyone who|anything designed|anything other|anythin'
        'g that|anything with|applicable copyright|applicable law|applicable patent|applicable section|applicable terms|applicable to|applications with|applied'
        ' to|applies also|applies to|apply along|apply and|apply either|apply if|apply it|apply local|apply only|apply these|apply to|appropriate copyright|app'
        'ropriate legal|appropriate parts|appropriately publish|approximates an|are a|are all|are applicable|are being|are considered|are designed|are granted|'
        'are imposed|are irrevocable|are met|are not|are packaged|are provided|are referring|are specifically|are terms|are used|are valid|are welcome|area of|'
        'arise substantially|arising out|arrange in|arrange to|arrangement or|arrangement with|arrangement you|article 11|as a|as an|as by|as changed|as differ'
        'ent|as exceptions|as excluding|as expressly|as is|as long|as needed|as part|as permitted|as provided|as published|as semiconductor|as such|as though|a'
        's to|as well|as you|as your|asking you|assert copyright|assets of|associated with|assume the|assumption of|assumptions directly|assumptions of|assures'
        ' that|at all|at least|at no|at your|attach the|attach them|attempt otherwise|attributed erroneously|attributions in|author attributions|author or|auth'
        'or this|authorization keys|authorized by|authorizes use|authorizes you|authorizing them|authors all|authors of|authors protection|authors sake|authors'
        ' you|automatic licensing|automatically extended|automatically from|automatically receives|automatically terminate|available for|available free|availab'
        'le network|available or|available to|avoid the|away your|b convey|b permanently|b primarily|b requiring|b serves|b the|based on|based the|basic permis'
        'sions|be accompanied|be attributed|be available|be construed|be deemed|be denied|be different|be given|be in|be included|be individuals|be infringed|b'
        'e liable|be marked|be of|be on|be resolved|be similar|be so|be stated|be to|be treated|be used|be useful|be written|because modification|been advised|'
        'been installed|been made|been modified|been terminated|behalf under|being offered|being rendered|believe are|below sublicensing|benefit of|best way|be'
        'tween those|beyond what|body or|both those|both users|box you|brief idea|business of|but changing|but do|but first|but for|but in|but it|but may|but n'
        'ot|but permits|but the|but this|but which|but without|by a|by anyone|by applicable|by contrast|by copyright|by court|by electronic|by exercising|by in'
        'timate|by its|by making|by modifying|by offering|by procuring|by software|by some|by the|by their|by third|by this|by works|by you|c 2007|c convey|c f'
        'or|c prohibiting|c should|c year|c you|called a|called an|called the|can apply|can be|can change|can decide|can do|can get|can give|can redistribute|c'
        'an regenerate|cannot be|cannot convey|carry prominent|case of|case prevented|cases shall|cases when|cause the|cause this|cease all|certain cases|certa'
        'in conditions|certain numbered|certain responsibilities|cessation moreover|change all|change the|change under|changed so|changing it|characterized the'
        '|charge and|charge any|charge c|charge for|charge under|charge you|choose any|choose that|choosing to|circumstances is|circumvention is|circumvention '
        'law|circumvention of|civil liability|claim is|claim or|claims are|claims owned|claims that|claims to|class of|clear directions|clearly explains|closel'
        'y approximates|code and|code as|code by|code either|code for|code form|code if|code in|code interpreter|code is|code keep|code means|code needed|code '
        'on|code or|code saying|code the|code under|code using|code whose|code with|code work|collect a|combination as|combine any|combined with|combined work|'
        'comes into|comes with|commands might|commands or|commands show|commercial industrial|commitment however|commitment not|common use|communication across'
        '|communication or|compilation and|compilation of|compilation s|compilations that|compiler used|compliance by|comply with|component and|component but|c'
        'omponent in|component kernel|component or|computer network|computer or|computers but|concerning interaction|concerns each|conditioned on|conditions 0|'
        'conditions a|conditions added|conditions additional|conditions are|conditions either|conditions for|conditions how|conditions of|conditions so|conditi'
        'ons stated|conditions type|connection with|consequence of|consequence you|consequential damages|consider it|considered further|consistent with|conspic'
        'uously and|constantly by|constitutes a|construed as|consumer product|consumer uses|contact you|contain the|containing it|contains a|content constitute'
        's|contents of|context means|continue to|continued functioning|contractual assumptions|contradict the|contrast the|contributor grants|contributor is|co'
        'ntributor s|contributor version|contributor whether|control copyright|control flow|control includes|control of|control on|control those|controlled by|'
        'convenient and|convey a|convey an|convey and|convey covered|convey individual|convey it|convey or|convey the|convey verbatim|convey without|conveyance'
        ' of|conveyed and|conveyed by|conveyed under|conveying all|conveying an|conveying from|conveying if|conveying modified|conveying non|conveying occurs|c'
        'onveying of|conveying the|conveying under|conveying verbatim|conveys the|copies made|copies mere|copies of|copies or|copies you|copy an|copy and|copy '
        'distribute|copy free|copy from|copy is|copy likewise|copy of|copy or|copy propagation|copy that|copy the|copy this|copying 7|copying distribution|copy'
        'ing facilities|copyleft license|copyright also|copyright are|copyright c|copyright disclaimer|copyright holder|copyright holders|copyright if|copyrigh'
        't law|copyright like|copyright line|copyright notice|copyright on|copyright permission|copyright those|copyright treaty|copyrightable work|copyrighted'
        ' material|correction 16|corresponding source|cost of|could give|could make|could satisfy|counterclaim in|countries other|country or|country that|count'
        'ry would|course your|court order|courts shall|covenant not|coverage for|coverage prohibits|covered by|covered work|covered works|criterion 1|cross cla'
        'im|cure the|customarily used|customer support|d convey|d if|d limiting|damages 17|damages arising|damages including|danger that|data being|data commun'
        'ication|data or|date b|days after|december 1996|decide which|declining to|deemed part|defective you|defenses to|defined by|definition control|definiti'
        'on files|definitions this|denied when|denominated not|deny users|denying you|deprive yourself|designated place|designed or|designed this|designed to|d'
        'etail to|details the|details type|details you|determining whether|develop a|developers and|developers that|developers working|development and|devices '
        'are|differ in|different for|different from|different permissions|different server|differently from|direction and|directions next|directly impose|direc'
        'tly or|disclaim any|disclaimer for|disclaimer of|disclaiming warranty|discriminatory if|discriminatory patent|display appropriate|displayed by|display'
        's an|displays appropriate|distinguishing version|distribute and|distribute copies|distribute verbatim|distributed in|distributing software|distributio'
        'n and|distribution medium|distribution with|do anything|do not|do so|do these|do use|do we|document but|document contains|document provided|documented'
        ' and|does copyright|does not|does terminal|domains in|domains we|doubtful cases|downstream recipients|durable physical|dwelling in|dynamically linked|'
        'e convey|e declining|each contributor|each copy|each file|each licensee|each must|each party|each source|each time|each version|earlier work|effect ac'
        'cording|effected by|effective technological|effectively proprietary|effectively state|efforts you|either 1|either expressed|either is|either of|either'
        ' the|either version|either way|electronic and|embodied in|employer if|enable use|enables other|end of|enforce a|enforcing against|enforcing compliance'
        '|ensure that|entered into|entire program|entire risk|entire work|entirely from|entity transaction|equivalent access|equivalent as|equivalent copying|e'
        'rroneously to|essential component|essential patent|even if|even the|event unless|ever published|every program|everyone can|everyone is|exact copy|exam'
        'ple corresponding|example if|example the|example you|except as|except executing|except to|except when|exceptions from|exceptions the|excluded from|exc'
        'luding or|exclusion of|exclusive worldwide|exclusively for|exclusively on|excuse you|executable work|execute modified|executing it|exercise of|exercis'
        'ing rights|expected to|expects or|explains that|explicitly affirms|explicitly and|express agreement|express permission|expressed or|expressly provided'
        '|extend the|extend this|extended to|extensions of|extent of|extent permitted|extent such|extent that|f requiring|facilities for|facilities provided|fa'
        'ils to|failure of|fair use|family or|fashion requiring|favor of|feature that|fee 5|fee end|fee royalty|fee you|file should|file to|files a|files assoc'
        'iated|files for|files or|finally every|finally terminates|find the|first please|first time|fitness for|fixed on|fixed term|flow between|follow a|follo'
        'w terms|follow the|following notices|following the|following three|for a|for all|for an|for and|for any|for anyone|for as|for at|for both|for communic'
        'ation|for copying|for damages|for details|for each|for enforcing|for example|for exercise|for further|for having|for incorporation|for individuals|for'
        ' infringement|for making|for material|for more|for most|for patent|for personal|for publicity|for purposes|for running|for sale|for shared|for softwar'
        'e|for that|for the|for them|for this|for those|for unpacking|for use|for which|for you|forbid circumvention|force you|form a|form and|form is|form mea'
        'ns|form of|form under|format that|forms you|found one|foundation either|foundation if|foundation inc|foundation may|foundation use|free copyleft|free '
        'of|free patent|free program|free programs|free software|free the|freedom if|freedom not|freedom of|freedom to|freedoms that|from a|from an|from anti|f'
        'rom any|from conveying|from denying|from making|from one|from or|from other|from running|from that|from the|from those|from time|from you|fsf org|fulf'
        'illing obligations|full notice|functioning of|fundamentally incompatible|further charge|further conveying|further modification|further restriction|fur'
        'ther restrictions|future versions|general public|general purpose|general special|generally available|generate install|get it|get the|get your|give all'
        '|give anyone|give appropriate|give the|give under|give you|given a|given its|given local|gives no|giving a|giving you|gnu affero|gnu general|gnu gpl|g'
        'nu lesser|gnu org|governed by|gpl as|gpl assures|gpl clearly|gpl protect|gpl requires|gpl see|gpl to|grant a|grant is|grant patent|grant rights|grant '
        'such|granted for|granted or|granted prior|granted under|grants to|grants you|gratis or|greatest possible|guarantee your|gui interface|had or|has been|'
        'has interactive|has it|has substantial|have actual|have at|have been|have certain|have designed|have or|have permission|have reason|have received|have'
        ' separately|have the|having copies|having them|hereafter acquired|holder and|holder as|holder explicitly|holder fails|holder is|holder notifies|holder'
        ' or|holder who|holders and|holders of|hope that|hosts the|household purposes|how the|how they|how to|however denominated|however if|however it|however'
        ' no|however nothing|https fsf|https www|hypothetical commands|idea of|identifiable patents|if a|if additional|if any|if authorized|if conditions|if it'
        '|if necessary|if neither|if not|if propagation|if pursuant|if such|if the|if this|if you|if your|implement a|implementation available|implementation i'
        's|implied including|implied license|implied warranties|implied warranty|import and|importing the|impose a|impose any|impose on|imposed on|in a|in acco'
        'rd|in an|in any|in certain|in connection|in conveying|in detail|in determining|in favor|in force|in future|in interest|in new|in no|in object|in one|i'
        'n or|in order|in other|in performing|in perpetuity|in reasonable|in return|in rom|in section|in some|in source|in spirit|in that|in the|in this|in tho'
        'se|in which|in writing|inability to|inaccurate or|inc https|incidental or|include a|include anything|include claims|include the|include within|include'
        'd in|includes a|includes copying|includes interface|includes the|including a|including any|including but|including scripts|inclusion of|incompatible w'
        'ith|incorporating your|incorporation into|indemnification of|independent works|indicate your|indicating where|individual copies|individual works|indiv'
        'iduals or|individuals to|industrial or|inform other|information but|information does|information for|information must|information on|information provi'
        'ded|information required|infringe copyright|infringe one|infringed by|infringed only|infringement that|infringement to|infringement under|initiate lit'
        'igation|inside them|install and|install modified|install or|installation information|installed access|installed by|installed in|instead of|intact all|'
        'intended to|intention to|interaction make|interaction through|interaction with|interactive interfaces|interactive mode|interactive user|interchange b|'
        'interchange for|interest had|interest if|interface definition|interface displays|interface for|interface means|interface presents|interface that|inter'
        'face you|interfaces each|interfaces specified|interfaces that|interfered with|interpretation of|interpreter used|intimate data|into a|into possession|'
        'into proprietary|into that|invalidate such|irrevocable provided|is a|is addressed|is allowed|is an|is any|is automatically|is available|is based|is ca'
        'lled|is characterized|is conditioned|is covered|is discriminatory|is distributed|is effected|is either|is excluded|is expected|is found|is free|is fun'
        'damentally|is given|is governed|is in|is included|is infringed|is intended|is most|is no|is normally|is not|is permitted|is precisely|is publicly|is r'
        'einstated|is released|is safest|is specifically|is that|is the|is threatened|is to|is transferred|is void|is what|is widely|is with|is without|it 11|i'
        't a|it additional|it and|it applies|it at|it contains|it d|it does|it effectively|it for|it free|it from|it has|it if|it in|it includes|it is|it more|'
        'it object|it on|it or|it output|it remains|it responsibilities|it starts|it such|it that|it the|it to|it under|it unnecessary|it will|it with|it you|i'
        'tem in|its authors|its conditions|its content|its contributor|its corresponding|its coverage|its parts|its resulting|its users|itself materially|june '
        '2007|keep intact|kernel window|key for|keys or|kind either|kind of|kinds of|know their|know you|knowingly relying|knowledge that|language one|language'
        ' the|larger program|later license|later version|law 12|law except|law for|law fulfilling|law if|law no|law or|law that|law you|laws prohibiting|laws t'
        'hat|lawsuit alleging|least the|least three|legal effect|legal notices|legal permission|legal power|legal rights|lesser general|lgpl html|liability acc'
        'ompanies|liability differently|liability in|liability provided|liability that|liability to|liable for|liable to|libraries and|libraries of|libraries o'
        'r|library if|library need|library you|license a|license acknowledges|license along|license an|license and|license any|license are|license as|license b'
        'ut|license by|license can|license copyright|license document|license does|license each|license explicitly|license fee|license for|license from|license'
        ' gives|license giving|license grants|license if|license in|license including|license instead|license into|license is|license notwithstanding|license o'
        'f|license on|license only|license or|license otherwise|license refers|license section|license shall|license the|license then|license therefore|license'
        ' they|license through|license to|license under|license version|license versions|license was|license will|license with|license without|license would|li'
        'cense you|license your|licensed is|licensed under|licensee is|licensees and|licensees may|licenses also|licenses are|licenses for|licenses granted|lic'
        'enses of|licenses the|licenses to|licenses why|licensing of|licensors and|licensors or|licensors to|like laws|like this|likewise does|limit operation|'
        'limit the|limitation of|limited to|limiting any|limiting liability|limiting the|line and|line to|link or|linked subprograms|linking proprietary|list m'
        'eets|list of|litigation including|local law|local legal|long as|loss of|losses sustained|machine readable|made from|made if|mail if|maintain clear|maj'
        'or component|major essential|make it|make modifications|make or|make payment|make run|make such|make sure|make them|make use|make you|makes it|making '
        'any|making available|making exceptions|making modifications|making of|making or|making using|manner consistent|manner permitted|manufacturer can|march'
        ' 2007|marked as|marked in|marks or|masks the|material added|material be|material by|material for|material governed|material or|material outside|materi'
        'al supplement|material under|material you|materially and|may add|may at|may be|may charge|may choose|may consider|may convey|may differ|may give|may i'
        'f|may make|may not|may offer|may otherwise|may place|may publish|may remove|meaning of|means a|means all|means an|means any|means copyright|means eith'
        'er|means of|means prior|means the|means then|means this|means to|means you|measure under|measures 4|measures to|measures when|medium accompanied|mediu'
        'm customarily|medium is|medium provided|meet all|meets this|menu a|merchantability and|merchantability or|mere interaction|merging organizations|met t'
        'his|methods procedures|might be|misrepresentation of|mode of|mode program|model to|modification follow|modification has|modification itself|modificati'
        'on making|modification of|modifications exclusively|modifications to|modified it|modified object|modified or|modified source|modified version|modified'
        ' versions|modifies and|modifies the|modify a|modify and|modify any|modify it|modify or|modify the|modifying a|modifying or|more details|more identifia'
        'ble|more information|more of|more than|more useful|moreover your|most closely|most effectively|most of|most software|most unacceptable|must be|must ca'
        'rry|must display|must do|must either|must license|must make|must pass|must place|must require|must show|must suffice|name and|name of|names of|names t'
        'rademarks|nature extensions|necessary for|necessary servicing|need not|need to|needed to|neither you|network corresponding|network may|network or|netw'
        'ork server|network will|network with|new free|new licenses|new problems|new program|new programs|new versions|next to|no additional|no case|no charge|'
        'no covered|no event|no further|no more|no permission|no price|no special|no surrender|no transfer|no warranty|non consumer|non exclusive|non exercise|'
        'non free|non permissive|non source|noncommercially and|nor any|normal form|normally used|not accept|not allow|not allowed|not apply|not available|not '
        'be|not by|not cause|not combined|not control|not convey|not conveying|not display|not excuse|not impose|not include|not initiate|not invalidate|not lg'
        'pl|not limited|not make|not part|not permanently|not permit|not price|not propagate|not qualify|not require|not required|not responsible|not see|not s'
        'pecify|not survive|not terminate|not to|not used|nothing in|nothing other|notice and|notice indicating|notice is|notice keep|notice like|notice of|not'
        'ice stating|notice termination|notices c|notices displayed|notices however|notices of|notices or|notices stating|notices to|notices your|notifies you|'
        'notify you|notwithstanding any|number if|number of|numbered version|object code|obligate you|obligated to|obligations are|obligations then|obligations'
        ' under|occasionally and|occurring solely|occurs as|occurs in|of a|of acceptance|of all|of an|of any|of author|of charge|of conveying|of copyright|of c'
        'ourse|of coverage|of data|of distributing|of downstream|of each|of enforcing|of fair|of following|of free|of further|of having|of how|of interfaces|of'
        ' it|of its|of liability|of licensors|of making|of merchantability|of names|of one|of or|of others|of our|of packaging|of parties|of physically|of poss'
        'ession|of previous|of product|of products|of propagation|of protecting|of rights|of section|of sections|of software|of some|of source|of specified|of '
        'such|of technological|of terms|of that|of the|of these|of this|of use|of user|of users|of using|of violation|of warranty|of what|of whether|of works|o'
        'f your|offer equivalent|offer for|offer in|offer spare|offer support|offer to|offer valid|offer you|offered to|offering access|offering for|official s'
        'tandard|on 20|on a|on any|on each|on general|on how|on it|on material|on of|on terms|on the|on this|on those|on to|on which|on you|on your|one line|on'
        'e of|one or|one that|only as|only if|only occasionally|only significant|only to|only way|operate with|operated by|operating system|operation of|operat'
        'ion or|option any|option of|option remove|options such|or 2|or 3|or a|or adapt|or affirmed|or agreed|or an|or any|or arrangement|or asking|or assumpti'
        'on|or at|or author|or authors|or b|or c|or can|or combine|or commitment|or common|or compilations|or concerns|or consequential|or control|or controlle'
        'd|or convey|or conveying|or conveys|or copies|or copying|or copyright|or correction|or could|or counterclaim|or covenant|or customer|or d|or data|or d'
        'ifferent|or distribution|or e|or embodied|or expects|or f|or fitness|or for|or from|or general|or generally|or hereafter|or household|or if|or implied'
        '|or importing|or in|or inability|or installed|or interfered|or is|or key|or legal|or limiting|or losses|or merging|or modification|or modified|or modi'
        'fy|or modifying|or more|or new|or no|or non|or of|or on|or options|or organizations|or other|or otherwise|or part|or propagate|or propagating|or provi'
        'de|or receive|or requiring|or restricting|or rights|or run|or running|or school|or secondarily|or selling|or service|or similar|or sold|or specificall'
        'y|or stated|or subdividing|or substantially|or that|or the|or third|or to|or updates|or use|or violates|or warranty|or with|or without|or your|order a'
        'greement|order to|org everyone|org licenses|organization or|organizations if|organizations to|origin of|original licensors|original version|other acti'
        'vities|other charge|other circumstances|other defenses|other domains|other equivalent|other information|other kinds|other non|other parties|other part'
        's|other party|other peers|other pertinent|other practical|other programs|other provision|other readily|other separate|other than|other way|other work|'
        'others for|others freedom|others from|otherwise be|otherwise remains|otherwise run|otherwise stated|otherwise that|otherwise to|our general|our softwa'
        're|out of|output a|output from|output given|outside their|own removal|owned or|packaged this|packaging a|paper mail|paragraph of|paragraph plus|paragr'
        'aphs a|part may|part of|part which|particular copyright|particular product|particular programming|particular purpose|particular user|particular work|p'
        'arties legal|parties or|parties provide|parties receiving|parties to|parties who|parties with|parts of|parts or|parts regardless|party based|party gra'
        'nts|party has|party if|party means|party retains|party s|party that|party to|party who|pass on|password or|patent against|patent claim|patent claims|p'
        'atent infringement|patent law|patent license|patent licenses|patent or|patent sublicenses|patent such|patents a|patents applied|patents cannot|patents'
        ' in|patents states|patents to|pattern of|payment to|peer to|peer transmission|peers where|performance of|performing this|performing those|permanently '
        'authorizes|permanently if|permanently reinstated|permission if|permission notwithstanding|permission other|permission to|permission would|permissions '
        'all|permissions apply|permissions are|permissions but|permissions from|permissions however|permissions may|permissions on|permissions that|permissions'
        ' when|permissive additional|permissive may|permissive or|permissive terms|permit inclusion|permit incorporating|permit linking|permits relicensing|per'
        'mitted above|permitted by|permitted solely|permitted to|perpetuity or|personal family|personal property|pertinent obligations|physical distribution|ph'
        'ysical medium|physical product|physically performing|pieces of|place additional|place at|place gratis|place in|place to|please read|plus a|pointer to|'
        'portion of|possesses the|possession and|possession of|possibility of|possible use|power to|practical works|practice a|practice for|preamble the|precis'
        'e terms|precisely where|predecessor has|predecessor in|preferred form|present version|presents a|preservation of|prevent others|prevent this|prevented'
        ' or|previous paragraph|previous versions|price for|price no|price or|price our|primarily for|prior to|private copy|problems arise|problems or|problems'
        ' will|procedures authorization|procuring conveyance|produce it|produce the|product a|product and|product doubtful|product for|product from|product has'
        '|product in|product including|product installation|product is|product means|product model|product received|product regardless|product that|product whi'
        'ch|products for|products if|products or|program 13|program ancillary|program and|program as|program comes|program copyright|program could|program does'
        '|program has|program if|program in|program including|program into|program is|program it|program later|program non|program or|program prove|program ref'
        'ers|program remains|program s|program shall|program specifies|program that|program the|program to|program unless|program whether|program you|programme'
        'r or|programming language|programs and|programs even|programs if|programs too|programs which|prohibit the|prohibit them|prohibiting misrepresentation|'
        'prohibiting or|prohibits the|prominent item|prominent notices|prominently visible|propagate a|propagate by|propagate covered|propagate modify|propagat'
        'e or|propagate that|propagate the|propagating a|propagation includes|propagation of|propagation that|property which|proprietary applications|proprieta'
        'ry programs|proprietary to|protect the|protect your|protecting users|protection for|protection the|protocols for|prove defective|provide installation|'
        'provide support|provide the|provide you|provided above|provided by|provided in|provided that|provided the|provided under|provided you|provision of|pro'
        'vision to|provisionally unless|proxy can|proxy s|public and|public at|public in|public license|public licenses|public statement|public the|publicity p'
        'urposes|publicly available|publicly documented|publish on|publish revised|published by|purpose computers|purpose of|purpose see|purpose the|purpose to'
        'ols|purposes of|purposes or|pursuant to|qualify to|quality and|read https|readable corresponding|readily accessible|reading or|ready to|reason to|reas'
        'onable cost|reasonable efforts|reasonable legal|reasonable means|reasonable ways|receipt of|receive a|receive copies|receive it|receive new|receive or'
        '|receive source|receive the|received a|received by|received copies|received it|received notice|received the|received you|receives a|receives whatever|'
        'receiving the|recipient automatically|recipient for|recipient in|recipient or|recipient s|recipients a|recipients each|recipients knowingly|recipients'
        ' may|recipients of|recipients the|recipients to|recognized standards|redistribute and|redistribute it|referring to|refers to|refrain entirely|regard t'
        'o|regardless of|regenerate automatically|reinstated a|reinstated permanently|reinstated you|relationship with|released this|released under|relevant da'
        'te|relevant source|relicensing or|relying means|relying on|remain obligated|remains free|remains governed|remains in|removal in|remove any|remove that'
        '|render the|rendered inaccurate|repair or|represent the|require acceptance|require no|require recipients|require such|require their|required by|requir'
        'ed for|required to|requirement does|requirement in|requirement modifies|requirement to|requirements apply|requirements e|requirements of|requires that'
        '|requiring copyright|requiring indemnification|requiring preservation|requiring that|resolved in|respect the|respect to|responsibilities if|responsibi'
        'lities to|responsible for|restrict development|restricting circumvention|restriction but|restriction does|restriction you|restrictions on|restrictions'
        ' within|result of|resulting copyright|resulting work|results from|retains the|return for|reviewing courts|revised and|revised versions|right of|right '
        'to|rights developers|rights from|rights granted|rights have|rights of|rights or|rights that|rights therefore|rights to|rights under|rights we|rights w'
        'ith|risk as|rom the|royalty for|royalty free|royalty or|rules and|run a|run and|run it|run modified|run modify|run the|running a|running the|running t'
        'hose|runs or|s commands|s contributor|s essential|s name|s predecessor|s public|s source|s system|s use|s users|safest to|sake the|sale import|sale or'
        '|same freedoms|same material|same place|same way|same work|satisfy both|satisfy simultaneously|satisfy these|saying where|school if|scope of|scripts t'
        'o|secondarily liable|section 10|section 11|section 13|section 4|section 7|section does|section in|section must|section you|sections 15|sections 4|see '
        'https|see the|sell offer|selling its|selling offering|semiconductor masks|separable portion|separate and|separately received|separately under|separate'
        'ly written|server at|server hosts|server operated|server or|server the|serves only|service marks|service warranty|servicing repair|shall apply|shall b'
        'e|share and|shared libraries|short notice|should also|should have|should not|should show|should the|show c|show the|show them|show w|sign a|significan'
        't mode|similar in|similar laws|simultaneously your|single combined|single transaction|so 10|so a|so as|so attach|so available|so exclusively|so long|s'
        'o on|so that|so they|so this|software and|software for|software foundation|software in|software inside|software interchange|software it|software on|so'
        'ftware or|software patents|software the|software under|software we|software which|software you|sold for|sole purpose|solely as|solely because|solely u'
        'nder|some countries|some devices|some manner|some of|some reasonable|some trade|source along|source as|source code|source conveyed|source file|source '
        'files|source fixed|source for|source form|source forms|source from|source in|source includes|source may|source need|source of|source or|source regardl'
        'ess|source the|source this|source to|source under|source versions|source you|spare parts|speak of|special danger|special incidental|special password|s'
        'pecial requirements|specific copy|specific operating|specific products|specifically designed|specifically for|specifically granted|specified for|speci'
        'fied reasonable|specifies that|specify a|spirit to|stand ready|standard defined|standard interface|standards body|start of|starts in|state the|stated '
        'as|stated below|stated conditions|stated in|statement of|states should|stating that|status of|steps 1|storage or|subdividing an|subject to|sublicenses'
        ' in|sublicensing is|subprograms and|subprograms that|subroutine library|subsection 6b|subsection 6d|substantial commercial|substantially all|substanti'
        'ally in|such 14|such a|such abuse|such an|such as|such circumvention|such damages|such holder|such material|such measures|such new|such permission|suc'
        'h problems|such relicensing|such uses|sue for|suffice to|supplement the|support for|support or|support service|supports equivalent|sure it|sure that|s'
        'urrender of|surrender the|survive such|sustained by|system and|system if|system libraries|system library|systematic pattern|take away|tangible persona'
        'l|technological measure|technological measures|tells the|term if|term of|term regardless|term that|terminal interaction|terminate the|terminate your|t'
        'erminated and|terminates your|termination of|termination you|terms a|terms added|terms additional|terms and|terms are|terms of|terms permissive|terms '
        'reviewing|terms so|terms that|terms to|than the|than this|than your|that 1|that a|that any|that apply|that are|that arrangement|that but|that class|th'
        'at contain|that contradict|that copy|that copyright|that country|that do|that either|that enables|that has|that is|that it|that language|that license|'
        'that licensees|that major|that material|that may|that modified|that most|that numbered|that obligate|that part|that patent|that patents|that product|t'
        'hat prohibit|that proxy|that same|that supplement|that supports|that term|that the|that their|that there|that these|that they|that this|that transacti'
        'on|that use|that user|that users|that version|that warranties|that without|that work|that would|that you|the ability|the above|the absence|the access|'
        'the additional|the aggregate|the aim|the applicable|the appropriate|the area|the benefit|the best|the business|the case|the cessation|the code|the com'
        'bination|the compilation|the conditions|the contents|the continued|the contributor|the conveying|the copyright|the corresponding|the cost|the covered|'
        'the developers|the disclaimer|the earlier|the entire|the exclusion|the executable|the exercise|the extent|the first|the following|the form|the free|th'
        'e freedom|the full|the further|the general|the gnu|the gpl|the greatest|the hope|the hypothetical|the implied|the individual|the information|the insta'
        'llation|the interface|the library|the license|the licenses|the list|the machine|the making|the manufacturer|the material|the meaning|the modification|'
        'the modifications|the modified|the network|the non|the normal|the notice|the object|the only|the operation|the option|the origin|the original|the othe'
        'r|the output|the part|the particular|the parties|the party|the patent|the place|the possibility|the practice|the precise|the predecessor|the preferred'
        '|the present|the previous|the product|the program|the public|the quality|the recipient|the recipients|the relevant|the requirement|the requirements|th'
        'e resulting|the right|the rights|the rules|the same|the scope|the software|the sole|the source|the special|the specific|the start|the stated|the statu'
        's|the system|the systematic|the term|the terms|the third|the transaction|the unmodified|the use|the user|the violation|the way|the whole|the wipo|the '
        'work|the works|the written|their nature|their own|their problems|their relationship|their rights|their terms|them although|them do|them from|them if|t'
        'hem make|them these|them to|then as|then the|then you|then your|there is|therefore apply|therefore by|therefore we|therefore you|these actions|these c'
        'onditions|these contractual|these requirements|these rights|these terms|these things|these ways|they are|they do|they know|they too|they were|things t'
        'o|third paragraph|third parties|third party|this alternative|this and|this context|this conveying|this criterion|this definition|this free|this is|thi'
        's license|this particular|this program|this provision|this requirement|this section|this the|this version|this way|this when|those activities|those co'
        'pies|those domains|those files|those licensors|those permissions|those products|those subprograms|those terms|those that|those thus|those to|those wor'
        'ks|though they|threatened constantly|three paragraphs|three years|through a|through the|thus licensed|thus making|time such|time to|time you|to 28|to '
        '30|to 60|to a|to accept|to achieve|to address|to all|to an|to any|to anyone|to apply|to attach|to authors|to avoid|to be|to believe|to change|to choos'
        'e|to collect|to contact|to continue|to control|to convey|to copy|to deny|to deprive|to distribute|to do|to downstream|to enable|to enforce|to ensure|t'
        'o extend|to find|to follow|to forbid|to form|to freedom|to generate|to give|to grant|to guarantee|to implement|to in|to infringement|to install|to it|'
        'to keep|to license|to limit|to link|to loss|to make|to modify|to most|to notify|to operate|to or|to other|to others|to part|to peer|to permit|to posse'
        'ssion|to practice|to prevent|to produce|to prohibit|to propagate|to protect|to provide|to receive|to redistribute|to refrain|to render|to require|to r'
        'espect|to restrict|to run|to satisfy|to share|to sign|to some|to sue|to surrender|to take|to terms|to that|to the|to their|to this|to those|to time|to'
        ' use|to version|to view|to where|to whom|to you|to your|too receive|too when|tools or|trade names|trademark law|trademarks or|transaction each|transac'
        'tion in|transaction is|transaction or|transaction transferring|transaction who|transfer of|transferred to|transferring control|transmission provided|t'
        'ransmission to|treated as|treaty adopted|two steps|type show|typical or|unacceptable therefore|under any|under applicable|under article|under certain|'
        'under section|under subsection|under the|under these|under this|under those|under trademark|under version|under which|under your|unless a|unless and|u'
        'nless required|unless such|unless you|unlimited permission|unmodified in|unmodified program|unnecessary 3|unpacking reading|until the|updates for|use '
        'an|use for|use in|use of|use or|use pieces|use propagate|use sell|use the|use to|use under|use which|use with|used among|used for|used refers|used sep'
        'arately|used that|used to|used unmodified|useful but|useful to|user actually|user commands|user interface|user interfaces|user normally|user or|user p'
        'roduct|user that|user through|users access|users and|users beyond|users can|users finally|users freedom|users legal|users we|users your|uses or|uses r'
        'epresent|uses unless|using or|using peer|using selling|valid for|valid if|valid under|verbatim copies|version 15|version 3|version a|version applies|v'
        'ersion but|version ever|version for|version in|version is|version number|version of|version or|version permanently|version published|version this|vers'
        'ions be|versions may|versions of|versions some|versions will|versions you|view a|violates the|violation by|violation of|violation prior|visible featur'
        'e|void and|volume of|w and|w this|waive any|waiver of|want it|want to|warranties are|warranties of|warranty and|warranty for|warranty of|warranty or|w'
        'arranty protection|warranty there|warranty without|was granted|way 8|way but|way by|way in|way through|way to|way you|ways a|ways as|we are|we have|we'
        ' need|we speak|we stand|we the|we wish|welcome to|well to|were included|what it|what server|what the|what you|whatever licenses|when it|when otherwise'
        '|when the|when we|when you|where it|where the|where to|whether a|whether already|whether by|whether gratis|whether the|which an|which are|which everyo'
        'ne|which future|which is|which it|which means|which the|which you|who authorizes|who comes|who conveys|who have|who modifies|who possesses|who receive'
        's|who would|whole of|whole that|whole under|whom you|whose source|why not|widely used|will any|will apply|will automatically|will be|will continue|wil'
        'l not|will therefore|window system|wipo copyright|wish that|wish to|with a|with absolutely|with an|with any|with contractual|with copies|with faciliti'
        'es|with it|with no|with or|with other|with reasonable|with respect|with section|with solely|with source|with specific|with subsection|with such|with t'
        'erms|with that|with the|with this|with two|with you|within the|without any|without conditions|without even|without modification|without permission|wit'
        'hout regard|without warranty|work 2|work a|work also|work and|work are|work as|work authorizing|work based|work but|work conveyed|work except|work for'
        '|work from|work has|work if|work in|work include|work including|work is|work knowingly|work licensed|work material|work means|work must|work need|work'
        ' occurring|work on|work or|work released|work results|work run|work runs|work s|work shall|work so|work subject|work that|work the|work then|work thes'
        'e|work this|work thus|work under|work unless|work with|work you|working in|works are|works based|works by|works containing|works for|works permit|work'
        's provided|works such|works that|works the|works to|works which|worldwide royalty|would be|would infringe|would make|would receive|would use|writing t'
        'he|writing will|written license|written offer|written to|www gnu|year name|years and|you a|you add|you additional|you agree|you also|you are|you assum'
        'e|you by|you can|you cannot|you cease|you comply|you conspicuously|you convey|you conveying|you could|you cure|you develop|you directly|you disclaim|y'
        'ou distribute|you do|you entered|you for|you from|you grant|you have|you indicate|you inform|you know|you legal|you licensees|you maintain|you make|yo'
        'u may|you modified|you modify|you must|you need|you nor|you of|you offer|you or|you permission|you receive|you received|you remain|you should|you thes'
        'e|you this|you to|you under|you waive|you want|you whether|you wish|you with|you work|you would|your acceptance|your activity|your behalf|your choosin'
        'g|your conveying|your copyrighted|your direction|your employer|your freedom|your license|your new|your obligations|your option|your or|your program|yo'
        'ur programs|your reasonable|your receipt|your recipient|your rights|your unlimited|your work|yourself of'
    ),
    'LGPL-2.1#text': (
        '0 this|02110 1301|1 above|1 and|1 april|1 february|1 of|1 preamble|1 uses|1 we|1 you|10 each|11 if|12 if|13 the|1301 usa|14 if|15 because|16 in|1990 t'
        'y|1991 1999|1999 copyright|1999 free|2 1|2 above|2 hence|2 in|2 instead|2 of|2 we|2 will|2 you|2d requires|3 you|4 you|5 a|51 franklin|6 any|6 as|6 ot'
        'herwise|6 states|6 whether|6a above|7 you|8 you|9 you|a accompany|a brief|a certain|a charge|a collection|a combined|a company|a consequence|a constan'
        't|a contradiction|a copy|a copyright|a court|a de|a derivative|a designated|a distinguishing|a facility|a failure|a fee|a free|a function|a given|a go'
        'od|a greater|a header|a large|a library|a license|a licensee|a medium|a modified|a more|a new|a newer|a notice|a particular|a patent|a pointer|a porti'
        'on|a program|a programmer|a purpose|a reference|a restrictive|a sample|a shared|a single|a software|a special|a storage|a suitable|a table|a the|a too'
        'l|a two|a version|a volume|a whole|a work|a written|able to|about whether|above and|above b|above be|above for|above on|above provided|above specified'
        '|above you|absence of|accept this|acceptance of|access to|accessors and|accompanies the|accompany it|accompany the|accompanying uncombined|achieve thi'
        's|act of|actions are|activities other|add an|add information|addition mere|address new|addressed as|advantage over|advantages in|advised of|affected b'
        'y|after making|aggregation of|agreed to|agreement applies|agreement or|all copyright|all derivatives|all for|all its|all modules|all necessary|all of|'
        'all subsequent|all the|all there|all third|all those|allegation of|allowed this|allowed to|along with|already present|already received|already sent|al'
        'so add|also called|also combine|also counts|also fall|also get|also if|also meet|also provides|also you|alter all|alter the|alternatively under|althou'
        'gh the|among countries|among them|an advantage|an application|an appropriate|an argument|an exception|an executable|an explicit|an object|and 2|and a|'
        'and accessors|and all|and any|and appropriately|and can|and change|and charge|and conditions|and copy|and data|and derivative|and disclaimer|and distr'
        'ibute|and each|and every|and explaining|and fitness|and if|and installation|and is|and its|and modification|and of|and or|and other|and output|and pap'
        'er|and passed|and performance|and performs|and provided|and recompiling|and reuse|and reverse|and separate|and small|and so|and that|and the|and then|'
        'and therefore|and this|and thus|and to|and use|and utility|and what|and will|and you|another language|another work|any application|any associated|any '
        'attempt|any change|any copyright|any data|any derivative|any executables|any free|any further|any general|any kind|any later|any medium|any other|any '
        'particular|any patent|any patents|any portion|any software|any such|any to|any version|any warranty|any work|anything that|appeared then|applicable la'
        'w|application does|application of|application program|application programs|application supplied|application therefore|application to|applies to|apply '
        'and|apply in|apply the|apply these|apply to|appropriate copyright|appropriately publish|april 1990|are a|are covered|are designed|are imposed|are inco'
        'mpatible|are informed|are intended|are linked|are not|are outside|are prohibited|are referring|are the|argument passed|arising out|as a|as an|as expre'
        'ssly|as if|as is|as its|as long|as object|as part|as permitted|as published|as separate|as such|as the|as to|as well|as widely|as you|ask for|ask you|'
        'associated interface|assume the|at all|at least|at no|at run|at your|attach the|attach them|attempt otherwise|attention to|author donor|author s|autho'
        'r this|author to|authorized party|authors who|automatically receives|automatically terminate|away your|b give|b use|b you|balance of|based on|be a|be '
        'able|be affected|be allowed|be combined|be consistent|be conveniently|be distributed|be guided|be introduced|be liable|be licensed|be linked|be of|be '
        'on|be optional|be reasonably|be similar|be supplied|be to|be true|be useful|because it|because the|becomes a|been advised|been distributed|being compi'
        'led|being rendered|believed to|below refers|below when|better strategy|between a|binary form|body of|boston ma|both it|both them|brief idea|bring the|'
        'but changing|but is|but may|but not|but we|but when|but without|by all|by an|by applicable|by being|by contrast|by copyrighted|by court|by electronic|'
        'by james|by law|by limiting|by modifying|by obtaining|by offering|by others|by patents|by permitting|by problems|by public|by side|by someone|by the|b'
        'y third|by this|by you|c 1991|c accompany|c library|c year|c you|call this|called a|called this|can be|can change|can do|can get|can modify|can redist'
        'ribute|can relink|can specify|can use|cannot distribute|cannot effectively|cannot impose|cannot use|carefully about|carry prominent|case based|case is'
        '|case there|case this|cases permission|cause the|certain countries|certain designated|certain libraries|certain library|certain responsibilities|certa'
        'in special|change c|change free|change in|change is|change it|change the|change you|changed the|changes the|changes to|changes were|changing it|charge'
        ' a|charge for|charge no|charge there|charge to|choice provided|choice this|choose any|circumstance the|circumstances for|circumstances it|claim rights'
        '|claims or|claims this|clear that|clear what|close attention|code 5|code and|code as|code derived|code even|code for|code from|code if|code is|code me'
        'ans|code of|code or|code plus|code so|code which|code with|collection of|collective works|combination fits|combination of|combine or|combined library|'
        'combined with|combined work|company cannot|compatible with|compelled to|competing non|compilation and|compiled or|compiler kernel|complete correspondi'
        'ng|complete machine|complete object|complete source|compliance 9|compliance by|component itself|components compiler|compute square|computer system|con'
        'cerns each|conditions a|conditions are|conditions either|conditions for|conditions how|conditions of|conditions you|consequence of|consequence you|con'
        'sequential damages|considered independent|consistent application|consistent with|conspicuously and|constant threat|constitute a|contact you|containing'
        ' portions|containing that|containing the|containing this|contains a|contains code|contains no|contains plus|contains portions|contents constitute|cont'
        'ents of|contest validity|contest your|contradict the|contradiction means|contradicts the|contrast the|contributions to|control compilation|control the'
        '|conveniently linked|convey the|coon 1|coon president|copies and|copies directly|copies of|copies or|copy an|copy and|copy distribute|copy for|copy fr'
        'om|copy it|copy modify|copy of|copy or|copy part|copy so|copy the|copy this|copying distributing|copying distribution|copying library|copyright c|copy'
        'right disclaimer|copyright holder|copyright holders|copyright interest|copyright law|copyright line|copyright notice|copyright notices|copyright the|c'
        'opyrighted by|copyrighted interfaces|correction 16|corresponding machine|cost of|could satisfy|countries either|countries not|countries so|counts as|c'
        'ourt judgment|court order|covered by|covered only|creates an|criteria for|criteria of|customarily used|customer s|d if|damages arising|damages end|dam'
        'ages including|data and|data being|data or|data prepared|data structure|data to|date of|de facto|debugging such|decide if|decide to|decision will|defe'
        'ctive you|defined by|defined independent|definition files|definitions b|definitions files|deny you|depends on|derivative of|derivative or|derivative w'
        'ork|derivative works|derivatives of|derived from|designated libraries|designated place|designated software|designed to|detail to|details you|develop a'
        '|developers less|differ in|difference between|different from|directing the|directly or|directly with|disadvantages are|disclaimer for|disclaimer of|di'
        'sclaims all|displays copyright|distinguishing version|distribute 7|distribute a|distribute and|distribute copies|distribute link|distribute so|distrib'
        'ute software|distribute such|distribute that|distribute the|distribute them|distribute verbatim|distributed in|distributed need|distributed through|di'
        'stributed under|distributing or|distributing the|distribution and|distribution conditions|distribution d|distribution is|distribution limitation|distr'
        'ibution medium|distribution of|distribution system|distributor we|distributors to|do not|do one|do so|do these|do this|document but|does 1|does and|do'
        'es copyright|does ensure|does less|does not|does the|donor to|during execution|e verify|each and|each copy|each distributor|each file|each licensee|ea'
        'ch source|each time|each version|effectively convey|effectively restrict|effort to|either by|either expressed|either of|either source|either the|eithe'
        'r verbatim|either version|electronic and|else and|else grants|employer if|enables a|enables many|encourage the|end of|enforcing compliance|engineering'
        ' for|ensure that|entire combination|entire risk|entire whole|entirely by|entirely from|entirely well|equivalent access|especially significant|even if|'
        'even the|even though|event an|event unless|ever published|every part|everyone can|everyone is|example a|example if|example on|example permission|excep'
        't as|except when|exception the|exception to|exceptions for|exchange for|excluded in|excluding those|exclusion of|excuse you|executable and|executable '
        'containing|executable form|executable from|executable is|executable it|executable linked|executable runs|executable that|executable the|executables co'
        'ntaining|executables the|executables when|execution displays|exercise of|exercise the|existence of|explaining where|explanations below|explicit geogra'
        'phical|expressed or|expressly provided|extend to|extent permitted|facilities is|facilities not|facilities that|facilities this|facility in|facility is'
        '|facility other|facility still|fact that|facto standard|failure of|faith effort|fall under|falls outside|february 1999|fee 2|fee for|fee you|fifth flo'
        'or|file is|file should|file that|file to|file uses|files and|files in|files modified|files plus|files to|finally software|find the|first released|firs'
        't think|fitness for|fits its|floor boston|follow pay|following notices|following the|for a|for all|for an|for any|for at|for certain|for copying|for d'
        'amages|for debugging|for distribution|for enforcing|for example|for linking|for making|for many|for more|for most|for other|for permission|for reprodu'
        'cing|for software|for that|for the|for this|for tweaking|for writing|for you|forbid distributors|form executables|form of|form under|form with|former '
        'contains|forming a|found one|foundation 14|foundation and|foundation either|foundation if|foundation inc|foundation may|foundation we|foundation write'
        '|franklin street|free for|free libraries|free library|free of|free program|free programs|free redistribution|free software|free status|freedom and|fre'
        'edom it|freedom of|freedom than|freedom the|freedom to|frequent case|frob a|from a|from distribution|from it|from such|from that|from the|from time|fr'
        'om you|full compliance|full freedom|full notice|function in|function must|function or|functions and|functions into|functions ten|further restrictions|'
        'gain by|gave you|general public|general special|generally no|generous contributions|geographical distribution|get it|get the|get your|give prominent|g'
        'ive the|given a|given copy|gives you|gnu c|gnu general|gnu lesser|gnu library|gnu linux|gnu operating|gnu software|goals of|good faith|gpl it|granted '
        'herein|grants you|gratis or|greater number|greatest possible|guarantee your|guided by|hacker signature|happen that|has a|has already|has appeared|has '
        'been|has the|have already|have at|have is|have made|have not|have received|have the|have their|he or|header file|held invalid|hence the|here is|hereby'
        ' disclaims|herein you|hereinafter translation|holder or|holder therefore|holder who|holders and|hope that|how to|however as|however linking|however no'
        'thing|however parties|however the|idea of|identifiable sections|if a|if any|if as|if distribution|if he|if identifiable|if its|if necessary|if not|if '
        'such|if the|if written|if you|implemented by|implied including|implied warranties|implied warranty|impose any|impose that|imposed on|in a|in addition|'
        'in an|in any|in certain|in detail|in either|in exchange|in full|in isolation|in it|in length|in new|in no|in non|in object|in or|in order|in other|in '
        'reliance|in spirit|in subsection|in such|in the|in themselves|in these|in this|in writing|inability to|inaccurate or|inc 51|inc hereby|incidental or|i'
        'nclude any|include anything|include the|included without|including any|including but|including some|including whatever|incompatible with|incorporate p'
        'arts|incorporates the|independent and|independent of|indicate your|indirectly through|induce you|information on|informed that|infringe any|infringemen'
        't or|inline functions|insist that|installation of|installs one|instead if|instead of|intact all|integrity of|intended to|intent is|intent of|interchan'
        'ge if|interest in|interface compatible|interface definition|interfaces the|into a|into another|into non|into other|into the|introduced by|invalid or|i'
        'nvoked then|irreversible for|is a|is addressed|is an|is believed|is called|is copyrighted|is covered|is designed|is distributed|is entirely|is especia'
        'lly|is found|is free|is given|is held|is implemented|is included|is intended|is interface|is invoked|is irreversible|is itself|is legally|is less|is l'
        'icensed|is linked|is little|is made|is modified|is no|is normally|is not|is one|is otherwise|is part|is permitted|is quite|is restricted|is safest|is '
        'that|is the|is therefore|is to|is true|is understood|is unrestricted|is up|is used|is useful|is void|is willing|is with|is without|isolation is|issues'
        ' conditions|it 10|it also|it and|it becomes|it by|it contains|it does|it either|it for|it free|it however|it if|it in|it is|it may|it that|it the|it t'
        'hus|it to|it too|it under|it very|it whether|it will|it with|it you|its contents|its criteria|its derivative|its purpose|its scope|its terms|its use|i'
        'ts users|its variant|itself 6|itself a|itself accompanies|itself be|james random|job as|judgment or|keep intact|kernel and|kind either|knobs written|k'
        'now that|know their|language hereinafter|large body|later version|latter must|law except|law if|law or|law that|lax criteria|layouts and|least the|lea'
        'st three|legal permission|legally a|legally speaking|length then|less in|less of|less protective|less to|lesser general|lesser gpl|lesser license|liab'
        'le to|libraries and|libraries however|libraries if|libraries in|libraries into|libraries is|libraries of|libraries that|library 4|library a|library ac'
        'tivities|library after|library already|library also|library among|library and|library as|library at|library b|library because|library below|library bu'
        't|library by|library complete|library creates|library does|library even|library except|library facilities|library for|library frob|library functions|l'
        'ibrary has|library if|library in|library including|library independent|library into|library is|library it|library itself|library means|library mechani'
        'sm|library must|library of|library on|library or|library prove|library provided|library public|library rather|library refers|library s|library side|li'
        'brary so|library specifies|library subject|library such|library the|library to|library together|library uncombined|library under|library uses|library '
        'we|library whereas|library whether|library will|library with|library you|license 11|license 12|license 13|license 3|license agreement|license along|li'
        'cense also|license and|license any|license applies|license as|license because|license d|license document|license each|license for|license from|license'
        ' has|license however|license if|license in|license incorporates|license instead|license is|license it|license may|license most|license obtained|licens'
        'e or|license permits|license practices|license provides|license restrictions|license section|license since|license so|license terms|license the|licens'
        'e therefore|license they|license this|license to|license version|license we|license which|license whose|license will|license would|license you|license'
        'd at|licensed free|licensee cannot|licensee is|licensees extend|licenses are|licenses for|licenses terminated|licensor to|limitation as|limitation exc'
        'luding|limitation in|limited to|limiting the|line and|line to|lines or|link a|link other|link with|linked directly|linked with|linked without|linking '
        'a|linking only|linking other|linking those|linking with|linux operating|little to|long as|loss of|losses sustained|ma 02110|machine readable|macros an'
        'd|made by|made from|made generous|made in|made with|mail you|major components|make a|make any|make exceptions|make it|make restrictions|make sure|make'
        ' thoroughly|making changes|making it|making modifications|many libraries|many more|many people|material from|materials from|materials or|materials spe'
        'cified|materials to|may add|may also|may at|may be|may charge|may choose|may copy|may differ|may distribute|may happen|may modify|may not|may opt|may '
        'place|may publish|meaningful for|means a|means all|means either|means the|means you|mechanism for|mechanism is|medium customarily|medium does|medium p'
        'rovided|meet all|merchantability and|merchantability or|mere aggregation|method 1|might be|modification 0|modification are|modification follow|modific'
        'ation of|modification source|modifications and|modifications or|modifications to|modifications you|modified by|modified definitions|modified executabl'
        'e|modified library|modified to|modified version|modified work|modify and|modify it|modify or|modify sublicense|modify the|modify your|modifying or|mod'
        'ifying the|modules it|more details|more frequent|more lax|more people|more than|most effectively|most gnu|most software|must alter|must be|must cause|'
        'must do|must give|must include|must itself|must make|must provide|must show|must still|must supply|name and|name of|names yoyodyne|necessarily be|nece'
        'ssary here|necessary servicing|need not|need to|needed for|new free|new libraries|new library|new problems|new versions|newer version|no charge|no der'
        'ivative|no event|no more|no warranty|non free|normally accompany|normally distributed|not a|not accept|not allowed|not apply|not based|not be|not brin'
        'g|not compelled|not copy|not covered|not derived|not distribute|not excuse|not have|not impose|not include|not limited|not make|not necessarily|not no'
        'rmally|not permit|not precisely|not price|not required|not responsible|not restricted|not signed|not specify|not supply|not the|not they|not thus|not '
        'whether|not write|nothing else|notice and|notice for|notice is|notice placed|notice with|notices once|notices stating|notices that|notices to|notices '
        'you|number 2|number if|number of|number you|numerical parameters|object code|object file|object files|obligations then|obligations under|obtained for|'
        'obtaining a|occasions there|of a|of all|of an|of another|of any|of author|of charge|of data|of definitions|of derivative|of each|of following|of free|'
        'of freedom|of it|of its|of merchantability|of object|of other|of our|of patent|of people|of performing|of preserving|of promoting|of protecting|of run'
        'ning|of section|of sections|of software|of such|of terms|of that|of the|of these|of this|of those|of to|of transferring|of ty|of use|of vice|of warran'
        'ty|of what|of whether|of who|of your|offer equivalent|offer valid|offer warranty|offer you|offering access|offering equivalent|on a|on consistent|on e'
        'ach|on how|on it|on of|on rare|on the|on what|on which|on you|once this|one as|one line|one of|one that|only if|only in|only numerical|only so|only wa'
        'y|operate properly|operate with|operates and|operating system|opt to|option any|option is|option of|option offer|optional if|or a|or agreed|or allegat'
        'ion|or alternatively|or among|or any|or at|or binary|or by|or can|or collective|or concerns|or consequential|or contest|or copies|or correction|or dat'
        'a|or derivative|or distribute|or distributing|or distribution|or executable|or fitness|or for|or if|or implied|or inability|or indirectly|or its|or le'
        'ss|or link|or linked|or losses|or modify|or modifying|or new|or not|or of|or other|or otherwise|or redistribute|or rights|or she|or source|or table|or'
        ' that|or the|or third|or to|or translated|or unenforceable|or use|or using|or with|or work|or works|or your|order agreement|order to|ordinary general|'
        'ordinary gnu|original author|original copyright|original library|original licensor|original version|other authorized|other authors|other cases|other c'
        'hange|other circumstances|other code|other free|other library|other licensees|other parties|other party|other pertinent|other program|other property|o'
        'ther proprietary|other reason|other software|other system|other than|other work|others finally|otherwise if|otherwise permitted|otherwise stated|other'
        'wise that|otherwise to|our decision|our free|our general|out of|output from|outside its|outside the|over competing|own use|packages typically|paper ma'
        'il|parameters data|part of|part regardless|particular case|particular circumstance|particular library|particular purpose|parties are|parties or|partie'
        's provide|parties remain|parties under|parties who|parties with|parts of|party has|party saying|party who|passed on|passed when|patent holder|patent i'
        'nfringement|patent issues|patent license|patents or|patents pose|pay close|people have|people to|performance of|performing this|performs whatever|perm'
        'ission for|permission to|permissions for|permit linking|permit modification|permit royalty|permits more|permits such|permitted above|permitted and|per'
        'mitted by|permitted only|permitted to|permitting redistribution|pertinent obligations|physical act|pieces of|place e|place library|place offer|place s'
        'atisfies|place then|placed by|places the|plus any|plus portions|plus the|pointer to|portion of|portion or|portions of|pose a|possibility of|possible u'
        'se|practices many|preamble the|precise terms|precisely defined|preferred form|prepared so|present on|present version|preserving the|president of|price'
        ' our|problems or|problems that|produce a|program by|program is|program that|program using|program we|program which|programmer or|programs and|programs'
        ' enables|programs must|programs needed|programs these|programs when|programs which|programs whose|prohibited by|prominent notice|prominent notices|pro'
        'moting the|properly with|property right|proprietary libraries|protect each|protect the|protect your|protecting the|protection in|protective of|prove d'
        'efective|provide complete|provide the|provided that|provided under|provides advantages|provides other|public license|public licenses|public we|publish'
        ' on|publish revised|published by|purpose of|purpose remains|purpose see|purpose that|purpose the|quality and|quite different|random hacker|range of|ra'
        're occasions|rather than|rather the|readable source|readable work|reason not|reason we|reasonably considered|receive copies|receive it|receive or|rece'
        'ive source|received a|received copies|receives a|recipient automatically|recipients all|recipients exercise|recipients should|recipients so|recommend '
        'making|recompile the|recompiling it|redistribute and|redistribute it|redistribute the|redistribution of|redistribution under|refer to|reference direct'
        'ing|referring to|refers to|refrain entirely|regardless of|released version|reliance on|relink them|relink to|remain in|remains meaningful|rendered ina'
        'ccurate|repair or|reproducing the|reputation will|required by|required form|required to|requirement contradicts|requirement to|requirements apply|requ'
        'ires that|responsibilities for|responsible for|rest of|restrict the|restricted and|restricted in|restrictions of|restrictions on|restrictions that|res'
        'trictions translate|restrictive license|reuse of|reverse engineering|revised and|right claims|right to|rights from|rights granted|rights or|rights tha'
        't|rights these|rights to|rights under|rights we|rights with|risk as|root function|roots has|roots these|royalty free|run gnu|run that|run time|running'
        ' a|runs unless|s all|s complete|s computer|s freedom|s name|s own|s reputation|safest to|same job|same place|same sections|same user|same work|sample '
        'alter|satisfies the|satisfy both|satisfy simultaneously|say a|saying it|school if|scope of|scope the|scripts used|section 1|section 2|section 6|sectio'
        'n as|section has|section is|section to|sections 1|sections above|sections as|sections of|sections when|see the|sent this|separate distribution|separat'
        'e works|service if|servicing repair|share and|shared library|sharing and|she is|should also|should have|should know|should the|show them|side by|side '
        'in|sign a|signature of|signed it|significant if|similar in|simultaneously your|since you|single library|small inline|small macros|so and|so as|so by|s'
        'o long|so on|so that|so the|so they|so we|software and|software are|software developers|software distributed|software distribution|software even|softw'
        'are for|software foundation|software functions|software generally|software including|software interchange|software is|software library|software only|s'
        'oftware packages|software patents|software that|software through|software to|software we|software which|software you|sole purpose|some libraries|some '
        'of|some specially|someone else|sometimes make|source along|source code|source file|source or|speak of|speaking a|special circumstances|special excepti'
        'on|special incidental|special need|specially designated|specified in|specified materials|specifies a|specify a|specify that|spirit to|square root|squa'
        're roots|standard to|start of|stated in|states terms|statically or|stating that|status of|step method|still compute|still fall|still operates|storage '
        'or|straightforwardly into|strategy to|street fifth|structure layouts|subject to|sublicense link|subsection 2d|subsection 6a|subsequent copies|successo'
        'r of|such a|such an|such case|such claims|such damages|such executables|such function|such holder|such linking|such modifications|such new|such partie'
        's|such software|suggest you|suitable mechanism|suitable shared|supplied by|supplied function|supply a|supply it|supply such|sure that|sure the|surrend'
        'er these|sustained by|system although|system and|system as|system in|system it|system on|system rather|system such|system which|table of|table the|tab'
        'le used|take away|ten lines|term modification|terminate your|terminated so|terms a|terms and|terms attach|terms do|terms for|terms of|terms or|terms p'
        'ermit|terms so|terms to|than a|than as|than copying|than the|than version|that 1|that a|that any|that are|that choice|that component|that contains|tha'
        't contradict|that copy|that distribution|that do|that everyone|that forbid|that in|that is|that it|that might|that part|that program|that refer|that s'
        '|that system|that the|that there|that they|that this|that uses|that version|that we|that what|that work|that you|the above|the absence|the accompanyin'
        'g|the act|the application|the author|the balance|the better|the body|the code|the combination|the combined|the complete|the conditions|the contents|th'
        'e copy|the copyright|the cost|the customer|the date|the difference|the distribution|the entire|the event|the exclusion|the executable|the existence|th'
        'e explanations|the extent|the facility|the fact|the files|the first|the following|the former|the free|the freedom|the full|the gnu|the greatest|the ho'
        'pe|the implied|the integrity|the intent|the latter|the lesser|the library|the license|the licenses|the limitation|the major|the materials|the modified'
        '|the names|the notices|the object|the only|the operating|the option|the ordinary|the original|the other|the physical|the possibility|the precise|the p'
        'referred|the present|the program|the public|the purpose|the quality|the reason|the recipient|the recipients|the required|the requirement|the rest|the '
        'right|the rights|the same|the scope|the scripts|the section|the sections|the separate|the sharing|the software|the sole|the source|the square|the star'
        't|the successor|the term|the terms|the threshold|the two|the use|the user|the users|the version|the wherewithal|the whole|the wide|the widest|the work'
        '|their licenses|their rights|them and|them as|them these|them to|them with|themselves then|then as|then offering|then relink|then the|then this|then y'
        'ou|there is|there may|therefore by|therefore covered|therefore falls|therefore permits|therefore subsection|therefore we|these actions|these condition'
        's|these disadvantages|these materials|these notices|these requirements|these restrictions|these rights|these terms|these things|these two|these write|'
        'they are|they can|they do|they have|they know|they refer|they too|things a|things to|think carefully|third parties|this case|this change|this distribu'
        'tion|this function|this is|this lesser|this library|this license|this must|this non|this object|this option|this our|this requirement|this section|thi'
        's service|this to|this user|this you|thoroughly clear|those countries|those functions|those libraries|those sections|those who|though the|though third'
        '|threat to|three years|threshold for|through any|through that|through you|thus excluded|thus forming|thus it|thus to|time a|time such|time to|time you'
        '|to a|to accept|to achieve|to address|to all|to any|to apply|to ask|to attach|to be|to carry|to certain|to claim|to compute|to contact|to contest|to c'
        'ontrol|to copy|to decide|to deny|to distribute|to do|to each|to encourage|to ensure|to exercise|to find|to form|to free|to freedom|to gain|to give|to '
        'guarantee|to in|to incorporate|to induce|to infringe|to it|to loss|to make|to modify|to most|to operate|to patent|to permit|to produce|to protect|to r'
        'ecompile|to refrain|to run|to satisfy|to say|to share|to sign|to some|to surrender|to take|to the|to these|to this|to those|to time|to use|to where|to'
        ' work|to you|to your|together in|together with|too but|too receive|tool for|transferring a|translate to|translated straightforwardly|translation is|tr'
        'ue depends|true is|tweaking knobs|two goals|two is|two step|two things|ty coon|typically libraries|uncombined form|uncombined with|under any|under cop'
        'yright|under section|under sections|under terms|under the|under these|under this|understood that|unenforceable under|unless required|unless that|unres'
        'tricted regardless|up to|usa also|usa everyone|use a|use and|use are|use both|use in|use it|use not|use of|use or|use pieces|use some|use specified|us'
        'e the|use this|use to|used by|used for|used in|used non|used to|useful but|useful when|user a|user can|user has|user installs|user of|user s|user the|'
        'user to|user who|users freedom|users of|users this|uses at|uses material|uses only|uses the|using a|using the|utility programs|valid for|validity of|v'
        'ariant the|verbatim copies|verbatim or|verify that|version 2|version but|version ever|version instead|version is|version number|version of|version or|'
        'version published|version so|version than|version that|version this|version you|versions of|versions will|very clear|vice that|void and|volume of|want'
        ' it|want to|warranties of|warranty 15|warranty and|warranty for|warranty keep|warranty of|warranty protection|warranty without|was made|way you|we are'
        '|we call|we copyright|we gave|we insist|we need|we offer|we protect|we recommend|we sometimes|we speak|we suggest|we use|we want|we wish|well as|well '
        'defined|were used|what is|what it|what the|what they|whatever changes|whatever part|when a|when otherwise|when the|when we|when you|where the|where to'
        '|whereas the|wherewithal to|whether by|whether gratis|whether it|whether or|whether statically|whether that|whether this|which applies|which contains|'
        'which gives|which has|which is|which must|which the|which use|who changes|who decide|who have|who may|who places|who receive|who wrote|whole and|whole'
        ' gnu|whole if|whole is|whole must|whole of|whole which|whose distribution|whose permissions|wide range|widely used|widest possible|will any|will autom'
        'atically|will be|will not|will operate|will still|willing to|wish do|wish that|wish to|with a|with any|with application|with c|with each|with it|with '
        'modifications|with or|with other|with the|with these|with this|with you|without any|without even|without limitation|without the|without warranty|work '
        '8|work a|work also|work are|work as|work based|work can|work containing|work during|work executables|work for|work in|work is|work may|work means|work'
        ' must|work not|work of|work that|work to|work under|work was|work which|work with|work written|works based|works but|works in|works made|works these|w'
        'ould be|would not|write to|writing it|writing the|writing will|written by|written entirely|written in|written offer|wrote it|year name|years to|you a|'
        'you accompany|you also|you are|you assume|you by|you can|you cannot|you changed|you conspicuously|you could|you develop|you distribute|you do|you firs'
        't|you for|you from|you have|you if|you indicate|you legal|you link|you may|you modify|you must|you or|you permission|you rather|you receive|you redist'
        'ribute|you should|you then|you these|you this|you to|you under|you want|you whether|you wish|you work|you you|your acceptance|your choice|your copy|yo'
        'ur employer|your freedom|your new|your obligations|your option|your rights|your school|yoyodyne inc'
    ),
    'LGPL-3.0#text': (
        '0 additional|0 convey|1 exception|1 use|2 conveying|2007 copyright|2007 free|29 june|3 29|3 and|3 object|3 of|4 combined|4 of|4d0 the|4d1 you|5 combin'
        'ed|6 of|6 revised|a accompany|a certain|a class|a combined|a copy|a covered|a distinguishing|a facility|a form|a function|a give|a good|a header|a mod'
        'e|a modified|a proxy|a reference|a single|a subclass|a suitable|a under|a uses|a version|a work|acceptance of|accessors or|accompany the|accompanying '
        'uncombined|additional definitions|additional permissions|address new|allowed this|already present|also called|also do|among these|an application|an ar'
        'gument|an interface|and 4|and accessors|and are|and b|and conditions|and convey|and corresponding|and distribute|and execute|and explaining|and in|and'
        ' its|and not|and only|and or|and performs|and reverse|and templates|and that|and the|and this|and under|and utility|any data|any later|any other|any s'
        'ource|any version|any work|applicable to|application and|application but|application code|application does|application including|application is|applic'
        'ation may|application or|application that|application with|applications and|applies to|apply that|are a|are based|are covered|are not|argument passed|'
        'as a|as an|as defined|as used|as well|as you|at run|authorization for|b accompany|b give|b under|b will|based on|be required|be similar|be supplied|be'
        'ing bound|below 0|below an|both of|bound by|but changing|but excluding|but may|but only|but which|by an|by combining|by recombining|by section|by side'
        '|by the|by this|c 2007|c for|called the|can decide|certain numbered|changing it|choice if|choice provided|choice that|choose any|choose that|class def'
        'ined|code and|code for|code form|code if|code in|code incorporating|code that|code under|code with|combined libraries|combined library|combined work|c'
        'ombined works|combining or|compatible with|computer system|concerns each|conditions either|conditions of|considered in|contained in|convey a|convey su'
        'ch|convey the|conveyed under|conveying corresponding|conveying modified|copies of|copy 3|copy and|copy of|copyright c|copyright notice|copyright notic'
        'es|corresponding application|corresponding source|covered by|covered work|d do|data and|data structure|data the|data to|debugging such|decide whether|'
        'deemed a|defined below|defined by|defining a|definitions as|detail to|differ in|directing the|displays copyright|distinguishing version|distribute ver'
        'batim|do both|do each|do not|do one|document 4|document but|document c|document d|does not|during execution|e provide|each copy|each of|each version|e'
        'ffectively do|effort to|either of|engineering for|ensure that|event an|ever published|everyone is|exception to|excluding any|excluding the|execute a|e'
        'xecution include|explaining where|extent that|facilities conveyed|facilities that|facility is|facility other|facility refers|facility still|faith effo'
        'rt|fewer lines|file that|files the|find the|following 0|following a|following the|for a|for and|for conveying|for debugging|for linking|for portions|f'
        'or reproducing|for the|for you|form of|form suitable|foundation if|foundation inc|foundation may|free software|from a|from library|from the|from time|'
        'fsf org|function or|functions and|future versions|general public|give prominent|given a|gnu general|gnu gpl|gnu lesser|good faith|governed by|gpl 2|gp'
        'l and|gpl for|gpl refers|gpl with|gpl you|have the|header file|header files|herein this|https fsf|if the|if you|in a|in detail|in isolation|in it|in l'
        'ength|in spirit|in the|in your|inc https|include the|including any|incorporate material|incorporated material|incorporates the|incorporating material|'
        'information but|information in|information is|information must|information under|inline functions|install and|installation information|interface compa'
        'tible|interface provided|invoked then|is a|is also|is any|is deemed|is given|is interface|is invoked|is necessary|is not|is one|is part|is permanent|i'
        's permitted|is used|isolation are|it and|it does|it is|it specifies|it you|its purpose|its use|june 2007|later version|layouts and|length you|lesser g'
        'eneral|libraries of|libraries you|library a|library already|library among|library and|library as|library but|library contained|library defining|librar'
        'y facilities|library header|library is|library mechanism|library refers|library side|library that|library the|library together|library uncombined|libr'
        'ary under|library with|library you|license and|license applicable|license b|license document|license ever|license from|license incorporates|license or'
        '|license other|license provided|license refers|license shall|license supplemented|license the|license version|license without|license you|limited to|l'
        'ines in|linked version|linking an|linking with|listed below|macros inline|made is|make a|makes use|manner specified|material from|material is|may choo'
        'se|may convey|may differ|may incorporate|may place|may publish|meaningful or|means the|mechanism for|mechanism is|minimal corresponding|mode of|modifi'
        'cation of|modifications a|modifications if|modified combined|modified version|modified versions|modify a|must accompany|must provide|necessary to|need'
        'ed for|new problems|new versions|none of|not allowed|not applications|not covered|not limited|not on|not otherwise|not restrict|not specify|not supply'
        '|notice for|notice with|notices as|notices during|number if|number of|numbered version|numerical parameters|object code|of a|of acceptance|of an|of an'
        'y|of following|of it|of its|of that|of the|of this|of using|of version|of your|on the|one of|one that|only if|only to|operate properly|operates and|op'
        'tion 4d0|option 4d1|option of|or a|or any|or b|or concerns|or data|or fewer|or linking|or new|or of|or relink|or relinking|or small|or source|org ever'
        'yone|other library|other than|otherwise based|otherwise be|parameters data|part of|particular version|passed when|performs whatever|permanent authoriz'
        'ation|permissions listed|permissions of|permit the|permitted to|place library|portions of|present on|present version|problems or|produce a|produced by'
        '|programs needed|prominent notice|properly with|provide installation|provide such|provide the|provided by|provided that|proxy can|proxy s|public licen'
        'se|public statement|publish revised|published by|published version|purpose remains|received it|recombine or|recombining or|reference directing|refers '
        'to|relink the|relinking the|remains meaningful|reproducing the|required to|restrict modification|reverse engineering|revised and|revised versions|run '
        'time|s computer|s public|same work|section 3|section 6|sections 3|shall apply|shared library|side by|side in|similar in|single library|small macros|so'
        'ftware foundation|source 1|source 5|source and|source code|source for|source under|specified by|specifies that|specify a|spirit to|statement of|still '
        'operates|structure layouts|subclass of|such a|such information|such modifications|such new|such object|suitable for|suitable mechanism|suitable shared'
        '|supplemented by|supplied by|supply the|system and|system libraries|taken together|templates ten|ten or|terms and|terms of|terms that|than an|than as|'
        'that a|that are|that considered|that copy|that displays|that if|that in|that is|that makes|that part|that permit|that proxy|that published|that such|t'
        'hat taken|that the|that uses|that version|that you|the accompanying|the additional|the application|the combined|the copies|the copyright|the correspon'
        'ding|the event|the extent|the facility|the following|the free|the function|the gnu|the incorporated|the installation|the library|the linked|the manner'
        '|the minimal|the modified|the object|the option|the particular|the portions|the present|the same|the system|the terms|the user|then you|these notices|'
        'this license|this version|time a|time such|time to|to a|to address|to be|to choose|to copy|to ensure|to find|to install|to it|to numerical|to produce|'
        'to provide|to recombine|to section|to that|to the|to time|to version|together effectively|together with|uncombined form|uncombined with|under section|'
        'under sections|under terms|under the|under this|use a|use are|use of|use option|used herein|used in|user s|user to|uses at|uses the|using an|utility p'
        'rograms|verbatim copies|version 3|version a|version applies|version but|version e|version for|version if|version is|version number|version of|version '
        'or|version published|version the|version to|versions if|versions of|versions will|was made|well as|whatever part|when the|where to|whether future|whic'
        'h is|which the|will be|will operate|with a|with any|with each|with none|with other|with the|with which|without being|work 1|work 6|work and|work as|wo'
        'rk based|work excluding|work from|work governed|work in|work is|work means|work produced|work that|work under|work was|work with|works you|would other'
        'wise|you also|you do|you have|you make|you may|you modify|you must|you received|you to|you use|you would|your choice|your modifications'
    ),
    'MPL-2.0#text': (
        '0 1|0 if|0 or|0 the|1 1|1 10|1 11|1 12|1 13|1 14|1 2|1 3|1 4|1 5|1 6|1 7|1 8|1 9|1 and|1 b|1 contributor|1 definitions|1 distribution|1 grants|1 new|1'
        ' of|1 or|1 the|1 with|10 1|10 2|10 3|10 4|10 modifications|10 versions|11 patent|12 secondary|13 source|14 you|2 0|2 1|2 2|2 3|2 4|2 5|2 6|2 7|2 above'
        '|2 are|2 contributor|2 distribution|2 effect|2 effective|2 if|2 license|2 or|3 0|3 1|3 2|3 3|3 4|3 5|3 and|3 contribution|3 distribution|3 in|3 limita'
        'tions|3 modified|3 no|3 responsibilities|30 days|4 2|4 are|4 covered|4 distributing|4 inability|4 notices|4 subsequent|5 1|5 2|5 3|5 application|5 inc'
        'ompatible|5 representation|5 termination|50 of|6 disclaimer|6 executable|6 fair|60 days|7 conditions|7 larger|7 limitation|8 license|8 litigation|9 li'
        'censable|9 miscellaneous|a any|a charge|a combination|a comply|a contract|a contributor|a copy|a distinguishing|a fee|a for|a jurisdiction|a larger|a '
        'legal|a license|a location|a modified|a new|a notice|a particular|a party|a patent|a provisionally|a recipient|a relevant|a result|a secondary|a separ'
        'ate|a source|a subsequent|a such|a text|a that|a the|a timely|a under|a work|a world|ability to|able to|above all|above be|above no|absence of|absolut'
        'ely clear|accurate notices|actions counter|add additional|addition to|additional accurate|additional disclaimers|additional grants|additional rights|a'
        'dditional terms|additionally distribute|affect such|affero general|after you|after your|against a|against any|against the|agree to|agreement concernin'
        'g|agreements excluding|all contributors|all distribution|all distributions|all end|all of|all other|alleging that|allow the|alone and|also be|also com'
        'ply|also under|alter any|alter or|alter the|an addition|an as|an essential|an individual|an ongoing|an unmodified|and 3|and all|and any|and apparatus|'
        'and b|and conditions|and cross|and distribute|and finally|and how|and limitation|and limitations|and modifications|and not|and otherwise|and performan'
        'ce|and remove|and resellers|and such|and that|and the|and to|and under|and until|and use|and you|any and|any character|any code|any contribution|any c'
        'ontributor|any covered|any direct|any entity|any file|any form|any jurisdiction|any kind|any later|any law|any liability|any license|any litigation|an'
        'y modifications|any necessary|any new|any of|any other|any patent|any provision|any references|any respect|any rights|any subsequent|any such|any used'
        '|anyone who|apparatus claims|applicable copyright|applicable law|application of|apply to|are conditions|are its|are reinstated|are the|as a|as defined'
        '|as described|as is|as may|as part|as permitted|as provided|as to|asserting a|assume the|at a|at http|at the|at their|attached exhibit|attached the|at'
        'tempt to|authorized under|automatically if|available in|available modify|available under|b above|b any|b describe|b for|b incompatible|b of|b on|b own'
        'ership|b that|b to|b under|b you|back into|basis if|basis with|basis without|be able|be attached|be brought|be construed|be given|be governed|be impli'
        'ed|be infringed|be liable|be likely|be made|be necessary|be placed|be reformed|be sufficiently|be under|be unenforceable|be used|become compliant|beco'
        'me effective|been informed|been validly|behalf and|behalf of|believes its|beneficial ownership|bring cross|brought only|business and|but for|but not|b'
        'y a|by any|by asserting|by contract|by covered|by i|by laws|by one|by or|by reasonable|by some|by statute|by such|by the|by this|by you|c under|can ob'
        'tain|case including|cause the|caused by|character including|charge a|charge no|choice provided|choice to|choose to|circumstances and|claim excluding|c'
        'laim s|claims 9|claims alleging|claims and|claims in|claims infringed|claims of|claims or|clear that|code form|code that|code they|combination of|comb'
        'ines covered|come back|commercial damages|common control|complete agreement|compliance by|compliance moreover|compliance with|compliant prior|complian'
        't then|comply due|comply with|computer failure|concerning the|conditions 2|conditions of|conditions sections|conflict of|consequential damages|constit'
        'utes an|construe this|construed against|contained within|contains any|contents of|contract or|contract shall|contribute must|contributes to|contributi'
        'on 1|contribution 2|contribution become|contribution means|contribution on|contributions are|contributions conveyed|contributions either|contributions'
        ' of|contributions or|contributions this|contributions with|contributor 1|contributor 10|contributor a|contributor and|contributor are|contributor as|c'
        'ontributor assume|contributor believes|contributor except|contributor explicitly|contributor fails|contributor first|contributor for|contributor has|c'
        'ontributor hereby|contributor makes|contributor means|contributor notifies|contributor or|contributor represents|contributor s|contributor that|contri'
        'butor to|contributor version|contributor you|contributors for|control means|control with|controlled by|controls is|conveyed by|copy of|copyright doctr'
        'ines|copyright notices|copyright ownership|correction this|cost of|counter claims|courts of|covered software|create a|create and|create or|create soft'
        'ware|creates contributes|creation of|creation s|cross claims|damages for|damages of|damages or|damages so|damages this|date the|days after|dealing or|'
        'death or|declaratory judgment|defective in|defects merchantable|defendant maintains|defined by|definition control|definitions 1|deletion from|describe'
        ' the|described in|description must|desirable to|detailed for|different terms|differs from|direct indirect|direct or|direction or|directly or|directory'
        ' where|disclaimer 7|disclaimer of|disclaimers of|display perform|distinguishing version|distribute a|distribute and|distribute covered|distribute sour'
        'ce|distribute such|distribute the|distributed with|distributes covered|distributes such|distributing source|distribution of|distribution or|distributi'
        'on to|distributions of|distributors and|distributors under|do not|do so|doctrines of|document 1|does not|drafter shall|due to|each case|each contribut'
        'ion|each contributor|each individual|each version|earlier of|effect of|effective date|effective for|either expressed|either its|either on|either the|e'
        'ither this|end user|enforceable any|entire risk|entities you|entity 2|entity by|entity exercising|entity that|entity whether|equivalents 2|essential p'
        'art|even if|event of|every contributor|except as|except that|except to|except under|excluding declaratory|excluding distributors|exclusion and|exclusi'
        'on or|exclusive license|executable form|exercising rights|exhibit a|exhibit b|explicitly and|exploit its|expressed implied|extent applicable|extent ne'
        'cessary|extent possible|extent prohibited|extent required|factual inaccuracies|fail to|fails to|failure or|fair dealing|fair use|fee for|fifty percent'
        '|file in|file included|file or|file then|file you|files that|finally terminates|first distributes|first time|fit for|following a|for a|for any|for dea'
        'th|for each|for infringements|for legal|for lost|for making|for purposes|for sale|for such|for the|for warranty|for you|form 1|form 3|form all|form an'
        'd|form as|form by|form does|form how|form if|form in|form including|form is|form license|form means|form of|form that|form then|form to|form under|fou'
        'ndation is|free non|free of|from a|from an|from covered|from or|from such|from the|from this|further distribute|general public|given a|gnu affero|gnu '
        'general|gnu lesser|goodwill work|governed by|grant any|grant of|grant or|grant scope|grant the|grant to|granted by|granted in|granted to|granted under'
        '|grants and|grants as|grants each|grants from|grants you|has attached|has removed|has sufficient|has the|have been|have come|have made|have received|h'
        'ave under|having made|having the|held to|hereby agree|hereby grants|hereof if|how they|however if|however you|http mozilla|i your|if a|if any|if it|if'
        ' permitted|if such|if the|if you|ii the|implied from|implied or|import and|import or|impossible for|in a|in any|in each|in executable|in exhibit|in se'
        'ction|in source|in the|in this|inability to|inaccuracies 3|incidental or|include additional|include the|included with|includes any|including any|inclu'
        'ding copyright|including negligence|including portions|including without|incompatible with|incurred by|indemnify every|indemnity or|indirect special|i'
        'ndirect to|indirectly infringes|individual or|inform recipients|informed of|infringed but|infringed by|infringement claim|infringements caused|infring'
        'es any|infringing the|initial contributor|initial grant|initiate litigation|injury resulting|intellectual property|intended to|into compliance|is a|is'
        ' authorized|is basis|is controlled|is free|is governed|is granted|is held|is impossible|is incompatible|is not|is offered|is provided|is subject|is th'
        'e|is under|is with|it 5|it absolutely|it enforceable|it has|it is|it under|its conflict|its contributions|its contributor|its original|its principal|i'
        'ts terms|judgment actions|judicial order|jurisdiction 4|jurisdiction where|jurisdiction without|jurisdictions do|kind either|known factual|language of'
        '|larger work|later versions|law or|law prohibits|law provisions|laws of|legal entities|legal entity|legal theory|lesser general|liability contained|li'
        'ability for|liability incurred|liability obligation|liability obligations|liability shall|liability specific|liability terms|liability under|liable to'
        '|licensable by|licensable means|license 1|license 10|license 2|license 3|license a|license against|license agreements|license and|license but|license '
        'by|license differs|license does|license each|license except|license file|license for|license from|license grants|license if|license is|license may|lic'
        'ense means|license must|license no|license notice|license notices|license notwithstanding|license on|license or|license permits|license prior|license '
        'represents|license s|license see|license shall|license steward|license the|license to|license under|license v|license version|license will|license wit'
        'h|license you|licenses 1|licenses and|licenses as|licenses granted|licenses if|licenses means|licenses no|licenses notice|licenses this|licenses under'
        '|licenses will|licensing of|likely to|limit any|limit or|limitation damages|limitation may|limitation method|limitation of|limitation some|limitation '
        'warranties|limitations and|limitations of|limitations on|litigation against|litigation any|litigation relating|litigation shall|location such|logos of'
        '|look for|loss of|losses even|lost profits|made available|made import|maintains its|make available|make it|make use|makes additional|making modificati'
        'ons|making using|malfunction or|management of|manner at|marks or|material in|matter hereof|maximum extent|may add|may alter|may at|may be|may choose|m'
        'ay create|may distribute|may do|may include|may not|means a|means an|means any|means covered|means each|means either|means having|means in|means prior'
        '|means source|means the|means this|merchantable fit|method process|miscellaneous this|modification of|modifications 1|modifications means|modification'
        's of|modifications or|modifications that|modified license|modified version|modified versions|modify display|modify or|more recipients|more secondary|m'
        'ore than|moreover your|mozilla foundation|mozilla org|mozilla public|mpl 2|mpl was|must a|must also|must be|must inform|must make|name of|necessary se'
        'rvicing|necessary to|negligence contract|negligence to|new file|new license|new versions|no additional|no circumstances|no contributor|no legal|no mor'
        'e|no one|no patent|no use|non compliance|non exclusive|non infringing|not allow|not also|not any|not apply|not attempt|not be|not covered|not distribu'
        'ted|not governed|not grant|not incompatible|not intended|not on|not possible|not remove|note that|nothing in|notice 5|notice described|notice in|notic'
        'e of|notice requirements|notice this|notice you|notices disclaimers|notices including|notices of|notices patent|notices to|notices you|notifies you|no'
        'tify you|notwithstanding section|number 10|obligation is|obligations to|obtain a|obtain one|of a|of additional|of any|of business|of copyright|of cove'
        'red|of defects|of distribution|of either|of executable|of fair|of goodwill|of incidental|of its|of law|of liability|of more|of new|of non|of or|of ord'
        'inary|of others|of section|of source|of such|of termination|of that|of the|of this|of those|of version|of warranty|of your|offer and|offer for|offer y'
        'ou|offered by|offering for|on an|on behalf|on grant|on the|on your|one at|one or|one other|ongoing basis|only in|only on|only rights|only to|option fu'
        'rther|or 5|or a|or all|or alter|or any|or anyone|or as|or b|or beneficial|or c|or consequential|or correction|or counter|or desirable|or earlier|or fi'
        'les|or ii|or indirect|or indirectly|or is|or it|or its|or legal|or liability|or licenses|or licensing|or limitation|or limitations|or logos|or losses|'
        'or malfunction|or management|or modification|or more|or non|or other|or otherwise|or owns|or personal|or publish|or regulation|or restrict|or statutor'
        'y|or sublicense|or subsequently|or such|or to|or trademark|or transfer|or under|or your|order or|ordinary skill|org mpl|original creation|originally r'
        'eceived|other commercial|other equivalents|other material|other software|other than|other third|others if|otherwise exploit|otherwise or|otherwise sha'
        'll|otherwise transfer|outstanding shares|own behalf|ownership exhibit|ownership of|owns covered|part of|particular contributor|particular file|particu'
        'lar purpose|party s|party shall|patent claim|patent claims|patent infringement|patent licensable|patent license|patent notices|patent or|patent then|p'
        'ercent 50|perform distribute|performance of|permits you|permitted above|permitted under|personal injury|place of|placed in|portions thereof|possibilit'
        'y of|possible and|possible or|possible whether|power direct|preferred for|prevent a|principal place|prior to|process and|profits loss|prohibited by|pr'
        'ohibits such|property rights|prove defective|provided in|provided that|provided under|provides that|provision of|provision shall|provisionally unless|'
        'provisions nothing|public license|publish new|published by|purpose or|purposes of|put the|quality and|reasonable means|receipt of|received notice|rece'
        'ived the|recipient and|recipient of|recipient would|recipients of|recipients rights|recipients that|reference to|references to|reformed only|regulatio'
        'n if|regulation such|regulation then|regulation which|reinstated a|reinstated on|relating to|relevant directory|remedy known|remove any|remove or|remo'
        'ved from|rename the|repair or|representation each|represents that|represents the|reproduce make|required to|requirements in|requirements of|resellers '
        'which|respect to|respect you|responsibilities 3|restrict the|result of|resulting from|results from|right to|rights conveyed|rights granted|rights in|r'
        'ights or|rights other|rights to|rights under|rights you|risk as|royalty free|s 3|s ability|s contribution|s including|s modifications|s negligence|s o'
        'r|s so|sale have|sale having|scope the|secondary license|secondary licenses|section 10|section 2|section 3|section shall|sections 3|sections 5|see sec'
        'tion|sell offer|selling offering|separate file|service marks|servicing repair|shall any|shall be|shall have|shall not|shall prevent|shall survive|shal'
        'l terminate|shares or|should any|skill to|so only|so that|so this|software 1|software as|software due|software except|software however|software if|sof'
        'tware in|software is|software means|software must|software not|software of|software or|software prove|software under|software was|software with|softwa'
        're you|some jurisdictions|some or|some reasonable|source code|source form|special incidental|specific to|statute judicial|statute or|statutory includi'
        'ng|steward 10|steward except|steward has|stoppage computer|subject matter|subject to|sublicense it|subsequent licenses|subsequent version|subsequently'
        ' any|substance of|such a|such as|such contribution|such contributor|such covered|such damages|such description|such entity|such executable|such limita'
        'tion|such litigation|such modified|such party|such provision|such secondary|such software|such source|such warranty|sufficient rights|sufficiently det'
        'ailed|support indemnity|survive termination|terminate 5|terminate automatically|terminates your|termination 5|termination 6|termination shall|terminat'
        'ion under|terms however|terms of|terms provided|terms you|text file|than fifty|than patent|than source|than the|that a|that any|that combines|that con'
        'tains|that controls|that creates|that is|that jurisdiction|that particular|that results|that such|that the|that would|that you|the absence|the code|th'
        'e combination|the complete|the contents|the contributions|the contributor|the cost|the courts|the covered|the creation|the date|the defendant|the dire'
        'ction|the distribution|the drafter|the entire|the event|the exclusion|the executable|the extent|the first|the following|the form|the gnu|the grant|the'
        ' initial|the language|the larger|the license|the licenses|the limitations|the making|the maximum|the mozilla|the mpl|the name|the non|the notice|the o'
        'nly|the outstanding|the possibility|the power|the quality|the recipient|the recipients|the requirements|the right|the rights|the source|the subject|th'
        'e substance|the terms|the time|the trademarks|the version|the work|their option|then a|then the|then you|theory whether|thereof 1|they affect|they can'
        '|third party|this definition|this disclaimer|this document|this exclusion|this file|this is|this license|this limitation|this section|this source|this'
        ' version|those licenses|time of|time you|timely manner|to 30|to 60|to additionally|to alter|to any|to be|to bring|to cause|to charge|to comply|to cons'
        'true|to create|to deletion|to distribute|to grant|to indemnify|to its|to liability|to limit|to look|to make|to modify|to note|to notify|to offer|to on'
        'e|to put|to remedy|to some|to statute|to termination|to the|to this|to understand|to use|to which|to you|tort including|trademark licensable|trademark'
        's service|transfer either|transfer of|under a|under applicable|under common|under different|under intellectual|under no|under patent|under section|und'
        'er sections|under terms|under the|under this|under which|understand it|unenforceable such|unless and|unmodified basis|until such|use a|use fair|use of'
        '|use reproduce|use sell|use this|used by|used to|user license|using selling|v 2|validly granted|version 1|version 2|version 3|version directly|version'
        ' means|version number|version of|version or|version published|version will|versions if|versions mozilla|versions of|versions you|want to|warranties th'
        'at|warranty and|warranty constitutes|warranty covered|warranty of|warranty or|warranty support|was made|was not|where a|where the|whether at|whether b'
        'y|whether tort|which have|which provides|which the|which you|who distributes|wide royalty|will be|will terminate|with a|with all|with any|with modific'
        'ations|with other|with respect|with secondary|with the|with this|with you|within the|without limitation|without reference|without warranty|work and|wo'
        'rk governed|work is|work may|work means|work other|work preferred|work stoppage|work that|work under|work you|world wide|would be|you 8|you a|you alon'
        'e|you also|you become|you by|you can|you choose|you contribute|you create|you distribute|you fail|you for|you have|you hereby|you includes|you initiat'
        'e|you may|you must|you not|you of|you offer|you or|you originally|you rename|you should|you to|you want|your and|your choice|your distributors|your gr'
        'ants|your means|your own|your receipt'
    ),
}
